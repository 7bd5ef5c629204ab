"""Queries for M1-M3: prompt context, rendered prompt, batch generation and
the rule-based default generator, over the questionnaire corpus."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.scratch import materialize
from ..functions.ship import ship_package
from ..functions.text import sql_str
from ..functions.url import duck_segments
from ..operators import prompt as M
from ..operators.ingest import parse_files, qa_pairs
from ..operators.sitemap import SITEMAP_NS, XML_DECL
from ..sources.fixtures import doc_files, qfiles
from .q_rules import ANCHOR, MENTIONED_SQL, PROFILE_SQL, _changefreq, _class_path, _lastmod, _pairs_cte, _priority
from ..functions.scratch import materialize, scratch_path
from ..operators.replies import generate_missing, replies_from_store
from .registry import register


def _parsed(spark, sf):
    return parse_files(qfiles(spark, sf).unionByName(doc_files(spark, sf)))


def _lit(s: str) -> str:
    return " || chr(10) || ".join(sql_str(p) for p in s.split("\n"))


_ENTRY = (f"{sql_str(M.PAIR_FORMAT[0])} || id || {sql_str(M.PAIR_FORMAT[1])} || question || "
          f"chr(10) || {sql_str(M.PAIR_FORMAT[2].lstrip(chr(10)))} || answer")
_CTX = f""",
ranked AS (SELECT file_id, id, {_ENTRY} AS e, row_number() OVER (PARTITION BY file_id ORDER BY id) AS rn FROM pairs),
ctx AS (SELECT file_id, count(*) AS n_pairs,
               string_agg(e, chr(10) || chr(10) ORDER BY id) FILTER (WHERE rn <= {M.MAX_PAIRS}) ||
               CASE WHEN count(*) > {M.MAX_PAIRS}
                    THEN chr(10) || chr(10) || {sql_str(M.MORE_FORMAT[0].lstrip(chr(10)))} || (count(*) - {M.MAX_PAIRS})
                         || {sql_str(M.MORE_FORMAT[1])} ELSE '' END AS qa_text
        FROM ranked GROUP BY file_id)"""
CTX_SQL = f"WITH {_pairs_cte()}" + _CTX


@register("prompt_context", CTX_SQL + "\nSELECT * FROM ctx")
def q_prompt_context(spark, sf):
    return M.file_prompt_context(_parsed(spark, sf))


@register("prompt_context_pairs", CTX_SQL + "\nSELECT * FROM ctx")
def q_prompt_context_pairs(spark, sf):
    return M.prompt_context(qa_pairs(_parsed(spark, sf)))


_HEAD, _TAIL = M.prompt_template()


@register("prompt_render", CTX_SQL + f"""
SELECT file_id, n_pairs, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5
FROM (SELECT *, {_lit(_HEAD.replace('{date}', ANCHOR))} || qa_text || {_lit(_TAIL)} AS p FROM ctx)""")
def q_prompt_render(spark, sf):
    r = M.prompt_render(M.file_prompt_context(_parsed(spark, sf)), ANCHOR)
    return r.select("file_id", "n_pairs", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@register("prompt_context_unlimited", f"""WITH {_pairs_cte()}
SELECT file_id, count(*) AS n_pairs, string_agg({_ENTRY}, chr(10) || chr(10) ORDER BY id) AS qa_text
FROM pairs GROUP BY file_id""")
def q_prompt_context_unlimited(spark, sf):
    return M.file_prompt_context(_parsed(spark, sf), k=None)


DATE_RE = re.compile(r"^Date: (\S+)$", re.M)
QUESTION_RE = re.compile(r"^Question ([0-9]+): ", re.M)
SITE_BASE = M.SITE_BASE


def offline_generator(prompts: list[str]) -> list[str]:
    """A stand-in for a model: a fenced sitemap with the homepage, dated by
    the prompt's Date line, and one page per question; raises when a prompt
    has no date."""
    out = []
    for prompt in prompts:
        m = DATE_RE.search(prompt)
        if m is None:
            raise ValueError("prompt has no Date line")
        pages = ["", *(f"answers/{i}" for i in QUESTION_RE.findall(prompt))]
        urls = "".join(f"  <url>\n    <loc>{SITE_BASE}{p}</loc>\n    <lastmod>{m.group(1)}</lastmod>\n  </url>\n" for p in pages)
        out.append(f"Pages: {len(pages)}\n\n```xml\n{XML_DECL}\n<urlset xmlns=\"{SITEMAP_NS}\">\n{urls}</urlset>\n```")
    return out


_REPLIES_SQL = CTX_SQL + f""",
asked AS (SELECT file_id, list_concat([''], list_transform(
              regexp_extract_all({_lit(_HEAD.replace('{date}', ANCHOR))} || qa_text || {_lit(_TAIL)}, '(?m)^Question ([0-9]+): ', 1),
              lambda i: 'answers/' || i)) AS pages FROM ctx)
SELECT file_id, 'Pages: ' || len(pages) || chr(10) || chr(10) || '```xml' || chr(10) || {sql_str(XML_DECL)} || chr(10) ||
       '<urlset xmlns="{SITEMAP_NS}">' || chr(10) || array_to_string(list_transform(pages, lambda p:
         '  <url>' || chr(10) || '    <loc>{SITE_BASE}' || p || '</loc>' || chr(10) || '    <lastmod>{ANCHOR}</lastmod>' || chr(10) ||
         '  </url>' || chr(10)), '') || '</urlset>' || chr(10) || '```' AS response, CAST(NULL AS VARCHAR) AS error
FROM asked"""


@register("generate_batch", _REPLIES_SQL)
def q_generate_batch(spark, sf):
    ship_package(spark)
    prompts = M.prompt_render(M.file_prompt_context(_parsed(spark, sf)), ANCHOR)
    return M.generate_batch(prompts, offline_generator)


@register("replies_stored", _REPLIES_SQL)
def q_replies_stored(spark, sf):
    """M3 through the reply store: two runs over the prompts, the second finds all replies stored."""
    ship_package(spark)
    prompts = materialize(M.prompt_render(M.file_prompt_context(_parsed(spark, sf)), ANCHOR).select("file_id", "prompt"), "prompts-rendered")
    store = scratch_path(spark, "reply-store")
    for _ in range(2):
        generate_missing(prompts, offline_generator, store, batches=2)
    return replies_from_store(prompts, store)


_PLANNED = f""",
{PROFILE_SQL.lstrip()},
ld(d, t) AS (VALUES {", ".join(f"({sql_str(a)}, {sql_str(b)})" for a, b in M.RT.LISTING_DETAIL)}),
ind(industry, pages) AS (VALUES {", ".join(f"({sql_str(k)}, [{', '.join(map(sql_str, v))}])"
                                          for k, v in M.RT.INDUSTRY_PAGES.items())}),
planned AS (
  SELECT DISTINCT file_id, path FROM (
    SELECT file_id, unnest(['', {', '.join(map(sql_str, M.RT.BASE_PAGES))}]) AS path FROM profile
    UNION ALL SELECT file_id, d FROM (SELECT file_id, unnest(dynamic_types) AS d FROM profile)
    UNION ALL SELECT file_id, d || '/' || t FROM (SELECT file_id, unnest(dynamic_types) AS d FROM profile) JOIN ld USING (d)
    UNION ALL SELECT file_id, unnest(pages) FROM profile p JOIN ind ON ind.industry = p.business_type
    UNION ALL SELECT file_id, unnest(legal_pages) FROM profile))"""


@register("planned_pages", f"WITH {_pairs_cte()}" + _PLANNED + "\nSELECT * FROM planned")
def q_planned_pages(spark, sf):
    from ..operators.rules import planned_pages, questionnaire_profile
    return planned_pages(questionnaire_profile(qa_pairs(_parsed(spark, sf))))


_NL = "chr(10)"


def _elem(name: str, col: str) -> str:
    esc = f"replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"'    <{name}>' || {esc} || '</{name}>' || {_NL}"


@register("generate_rule_based", f"WITH {_pairs_cte()}" + _PLANNED + f""",
u AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY path <> '', path) AS pos,
             '{M.SITE_BASE}' || path AS url FROM planned),
a AS (SELECT file_id, pos, url, {_class_path(duck_segments("url"))} AS cp FROM u),
e AS (SELECT file_id, pos, '  <url>' || {_NL} || {_elem('loc', 'url')} ||
             {_elem('lastmod', f"CAST({_lastmod('url', 'cp')} AS VARCHAR)")} ||
             {_elem('changefreq', _changefreq('cp'))} ||
             {_elem('priority', f"CAST({_priority('cp')} AS VARCHAR)")} || '  </url>' || {_NL} AS entry FROM a)
SELECT file_id, '```xml' || {_NL} || {sql_str(XML_DECL)} || {_NL} || '<urlset xmlns="{SITEMAP_NS}">' || {_NL} ||
       string_agg(entry, '' ORDER BY pos) || '</urlset>' || {_NL} || '```' AS response,
       CAST(NULL AS VARCHAR) AS error
FROM e GROUP BY file_id""")
def q_generate_rule_based(spark, sf):
    return M.rule_based_replies(qa_pairs(_parsed(spark, sf)), ANCHOR)


RUN_TS = "2025-01-01 12:00:00"


@register("site_pipeline", f"WITH {_pairs_cte()}" + _PLANNED + f""",
np AS (SELECT file_id, count(*) AS n_pairs FROM pairs GROUP BY file_id),
segs AS (SELECT file_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM planned),
st AS (SELECT file_id, count(*) AS n_urls, count(*) FILTER (WHERE len(s) <= 1) AS main_pages,
              count(*) FILTER (WHERE len(s) >= 2) AS subpages FROM segs GROUP BY file_id),
ln AS (SELECT file_id, count(DISTINCT p) AS n_lines
       FROM (SELECT file_id, array_to_string(s[1:k], '/') AS p
             FROM (SELECT file_id, s, unnest(generate_series(1, least(len(s), 7))) AS k FROM segs)) GROUP BY file_id)
SELECT p.file_id, CAST(len(p.rows) AS INTEGER) AS n_rows, CAST(coalesce(len(p.header), 0) AS INTEGER) AS n_columns,
       coalesce(n_pairs, 0) AS n_pairs, coalesce(n_urls, 0) AS n_urls, coalesce(main_pages, 0) AS main_pages,
       coalesce(subpages, 0) AS subpages, coalesce(n_lines, 0) AS n_lines, client_name,
       'sitemap_structure-' || CASE WHEN client_name IS NULL OR client_name IN ('', 'sitemap')
         THEN 'sitemap_' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d_%H%M%S') ELSE client_name END || '.txt' AS output_name,
       CASE WHEN status <> 'ok' THEN status WHEN n_pairs IS NULL THEN 'no_pairs' END AS error
FROM parsed p LEFT JOIN roles r USING (file_id) LEFT JOIN np USING (file_id) LEFT JOIN st USING (file_id) LEFT JOIN ln USING (file_id)""")
def q_site_pipeline(spark, sf):
    from ..operators import results
    facts = results.file_facts(_parsed(spark, sf))
    replies = materialize(M.rule_based_replies(results.pairs_of(facts), ANCHOR), "replies")
    return results.site_results(facts, replies, F.to_timestamp(F.lit(RUN_TS)))


@register("estimated_pages", f"WITH {_pairs_cte()}" + _PLANNED + """
SELECT file_id, count(*) AS estimated_pages FROM planned GROUP BY file_id""")
def q_estimated_pages(spark, sf):
    from ..operators.rules import estimated_pages, questionnaire_profile
    return estimated_pages(questionnaire_profile(qa_pairs(_parsed(spark, sf))))


@register("profile_findings", f"WITH {_pairs_cte()}" + _PLANNED + """,
kept AS (SELECT * FROM planned WHERE length(path) % 3 <> 0),
est AS (SELECT file_id, count(*) AS e FROM planned GROUP BY file_id),
got AS (SELECT file_id, count(*) AS n FROM kept GROUP BY file_id)
SELECT file_id AS site_id, '/' || path AS url, 'industry' AS rule, business_type AS detail
FROM (SELECT file_id, business_type, unnest(pages) AS path FROM profile p JOIN ind ON ind.industry = p.business_type) x
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.file_id = x.file_id AND k.path = x.path)
UNION ALL
SELECT file_id, '/' || path, 'legal', 'profile' FROM (SELECT file_id, unnest(legal_pages) AS path FROM profile) x
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.file_id = x.file_id AND k.path = x.path)
UNION ALL
SELECT file_id, NULL, 'page_count', 'expected ' || e || ' got ' || coalesce(n, 0)
FROM est LEFT JOIN got USING (file_id) WHERE coalesce(n, 0) < e""")
def q_profile_findings(spark, sf):
    """Sites that lack every planned page whose path length is a multiple of three."""
    from ..operators.rules import planned_pages, profile_findings, questionnaire_profile
    profile = materialize(questionnaire_profile(qa_pairs(_parsed(spark, sf))), "profile")
    pages = planned_pages(profile).filter(F.length("path") % 3 != 0)
    records = pages.select(F.col("file_id").alias("site_id"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit(SITE_BASE), F.col("path")).alias("url"))
    return profile_findings(records, profile)


@register("profile_details", f"WITH {_pairs_cte()}" + _PLANNED + f""",
{MENTIONED_SQL.lstrip()},
pages AS (SELECT file_id, list_sort(list(DISTINCT value)) AS explicit FROM said WHERE value NOT LIKE '=%' GROUP BY file_id),
votes AS (SELECT file_id, value[2:] AS approach, count(*) AS n FROM said WHERE value LIKE '=%' GROUP BY file_id, value),
chosen AS (SELECT file_id, first(approach ORDER BY n DESC, list_position({M.RT.ML_APPROACHES!r}, approach)) AS named FROM votes GROUP BY file_id),
implied AS (SELECT file_id, list_sort(list(path)) AS implied FROM planned GROUP BY file_id)
SELECT p.file_id, coalesce(explicit, []::VARCHAR[]) AS explicit_pages, implied AS implied_pages,
       coalesce(named, CASE WHEN multilingual THEN {sql_str(M.RT.ML_DEFAULT)} END) AS language_approach,
       CASE WHEN business_type IN ({', '.join(map(sql_str, M.RT.INDUSTRY_PAGES))}) THEN business_type ELSE 'general' END AS industry
FROM profile AS p LEFT JOIN pages USING (file_id) LEFT JOIN chosen USING (file_id) LEFT JOIN implied USING (file_id)""")
def q_profile_details(spark, sf):
    from ..operators.rules import profile_details, questionnaire_profile
    pairs = materialize(qa_pairs(_parsed(spark, sf)), "pairs")
    return profile_details(pairs, materialize(questionnaire_profile(pairs), "profile"))
