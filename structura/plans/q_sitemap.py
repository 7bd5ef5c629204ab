"""Queries for S4, P1-P3 and M4 over sitemap documents built from ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import duck_strip, sql_str
from ..operators import sitemap as S
from ..sources.fixtures import IMAGE_ENTRY, IMAGE_NS, OTHER_NS, page_urls, replies, sitemap_docs
from .registry import register
from .sqlparts import page_urls_cte

NL = "chr(10)"
NS = S.SITEMAP_NS
# the twin's own patterns
NS_DECL_RE = r"""xmlns(:[A-Za-z_][A-Za-z0-9_.\-]*)?\s*=\s*["']http://www\.sitemaps\.org/schemas/sitemap/0\.9["']"""
LOC_RE = r"<loc>([^\n]*?)</loc>"


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _elem(name: str, col: str) -> str:
    body = f"'    <{name}>' || {_esc(col)} || '</{name}>' || {NL}"
    return body if name == "loc" else f"(CASE WHEN {col} <> '' THEN {body} ELSE '' END)"


def _variant(n: int) -> str:
    return f"((ascii(substr(md5(site_id), 1, 1)) * 7 + ascii(substr(md5(site_id), 2, 1))) % {n})"


def _lit(s: str) -> str:
    """A SQL literal for text that may hold newlines."""
    parts = s.split("\n")
    return f" || {NL} || ".join(sql_str(p) for p in parts)


WRITE_CTE = f"""{page_urls_cte()},
entries AS (
  SELECT site_id, CAST(0 AS BIGINT) AS chunk, pos,
         '  <url>' || {NL} || {_elem('loc', 'url')} || {_elem('lastmod', 'lastmod')} ||
         {_elem('changefreq', 'changefreq')} || {_elem('priority', 'priority')} || '  </url>' || {NL} AS entry
  FROM urls),
written AS (
  SELECT site_id, chunk, count(*) AS n_urls,
         {sql_str(S.XML_DECL)} || {NL} || '<urlset xmlns="{NS}">' || {NL} ||
         string_agg(entry, '' ORDER BY pos) || '</urlset>' || {NL} AS xml
  FROM entries GROUP BY site_id, chunk)"""


def _first_loc(x: str, repl: str) -> str:
    return (f"substr({x}, 1, instr({x}, '<loc>') - 1) || {repl} || "
            f"substr({x}, instr({x}, '</loc>' || {NL}) + 7)")


_ROOT = f'<urlset xmlns="{NS}">'
DOCS_CTE = WRITE_CTE + f""",
docs AS (
  SELECT site_id, chunk, v AS variant, CASE v
    WHEN 1 THEN replace(replace(replace(replace(replace(replace(replace(xml,
         '{_ROOT}', '<sm:urlset xmlns:sm="{NS}">'), '</urlset>', '</sm:urlset>'),
         '<url>', '<sm:url>'), '</url>', '</sm:url>'), '<loc>', '<sm:loc>'),
         '</loc>', '</sm:loc>'), '<lastmod>', '<sm:lastmod>')
    WHEN 2 THEN replace(xml, ' xmlns="{NS}"', '')
    WHEN 3 THEN replace(xml, '{NS}', '{OTHER_NS}')
    WHEN 4 THEN replace(xml, '</urlset>', '<note>R&D</note>' || {NL} || '</urlset>')
    WHEN 5 THEN substring(xml, 1, (length(xml) * 2) // 3)
    WHEN 6 THEN ' ' || xml
    WHEN 7 THEN {_first_loc('xml', "'<loc/>' || " + NL)}
    WHEN 8 THEN {_first_loc('xml', "''")}
    WHEN 9 THEN replace(replace(xml, '{_ROOT}', '<urlset xmlns="{NS}" xmlns:image="{IMAGE_NS}">'),
                        '  </url>', {_lit(IMAGE_ENTRY)})
    ELSE xml END AS xml
  FROM (SELECT *, {_variant(10)} AS v FROM written))"""


@register("sitemap_write", f"WITH {WRITE_CTE} SELECT * FROM written")
def q_sitemap_write(spark, sf):
    return S.sitemap_write(page_urls(spark, sf))


# The twin recognises the fixture's defects (leading blank, bare '&',
# missing end tag) as "malformed"; the Spark side asks the XML reader.
_ENT = "&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"
_PRE = "(?:sm:)?"
PARSE_CTE = DOCS_CTE + f""",
flagged AS (
  SELECT site_id, chunk, xml,
         (NOT starts_with(xml, '<')
          OR regexp_matches(regexp_replace(xml, '{_ENT}', '', 'g'), '&')
          OR NOT regexp_matches(xml, '</([A-Za-z_][A-Za-z0-9_.-]*:)?urlset>\\s*$')) AS malformed,
         regexp_matches(xml, {sql_str(NS_DECL_RE)}) AS ns_ok
  FROM docs),
blocks AS (
  SELECT site_id, chunk, unnest(b) AS blk, generate_subscripts(b, 1) - 1 AS pos
  FROM (SELECT site_id, chunk, regexp_extract_all(xml, '(?s)<{_PRE}url>(.*?)</{_PRE}url>', 1) AS b
        FROM flagged WHERE NOT malformed AND ns_ok)),
structured AS (
  SELECT site_id, chunk, CAST(pos AS BIGINT) AS pos,
         @loc@ AS url, @lastmod@ AS lastmod, @changefreq@ AS changefreq,
         @priority@ AS priority, 'xml' AS method
  FROM blocks WHERE regexp_matches(blk, '<{_PRE}loc(>|/>)')),
fallback AS (
  SELECT site_id, chunk, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS pos,
         {duck_strip('unnest(m)')} AS url, '' AS lastmod, '' AS changefreq, '' AS priority,
         'regex' AS method
  FROM (SELECT site_id, chunk, regexp_extract_all(xml, {sql_str(LOC_RE)}, 1) AS m
        FROM flagged WHERE malformed))"""


def _field(name: str) -> str:
    val = f"regexp_extract(blk, '(?s)<{_PRE}{name}>(.*?)</{_PRE}{name}>', 1)"
    unesc = f"replace(replace(replace({val}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return (f"(CASE WHEN regexp_matches(blk, '<{_PRE}{name}>') THEN {duck_strip(unesc)} "
            f"ELSE '' END)")


for _n in S.URL_FIELDS:
    PARSE_CTE = PARSE_CTE.replace(f"@{_n}@", _field(_n))
_KEYS = ("site_id", "chunk")


@register("sitemap_parse", f"WITH {PARSE_CTE} SELECT * FROM structured UNION ALL SELECT * FROM fallback",
          )
def q_sitemap_parse(spark, sf):
    return S.sitemap_parse(sitemap_docs(spark, sf), _KEYS)


@register("sitemap_parse_fallback", f"WITH {PARSE_CTE} SELECT * FROM fallback")
def q_sitemap_parse_fallback(spark, sf):
    return S.sitemap_parse(sitemap_docs(spark, sf), _KEYS).filter("method = 'regex'")


def _strip_fences(e: str) -> str:
    return (f"regexp_replace(regexp_replace({e}, {sql_str(S.OPEN_FENCE_RE)}, '', 'g'), "
            f"{sql_str(S.CLOSE_FENCE_RE)}, '')")


def _with_decl(e: str) -> str:
    return (f"(CASE WHEN starts_with({e}, '<?xml') THEN {e} "
            f"ELSE {sql_str(S.XML_DECL)} || {NL} || {e} END)")


_BODY = f"substring(xml, {len(S.XML_DECL) + 2})"
REPLIES_CTE = WRITE_CTE + f""",
replies AS (
  SELECT site_id || '#' || CAST(chunk AS VARCHAR) AS file_id, CASE {_variant(5)}
    WHEN 0 THEN {_lit('ANALYSIS:\nBusiness Type: shop\n\n```xml\n')} || xml || {_lit('```\n\nNOTES: none')}
    WHEN 1 THEN '```XML' || {NL} || {_BODY} || '```'
    WHEN 2 THEN 'Here is the sitemap for ' || site_id || ':' || {NL} || xml || {NL} || 'NOTES: generated.'
    WHEN 3 THEN 'Sitemap below.' || {NL} || {_BODY} || {NL} || 'Thanks.'
    ELSE 'I could not build a sitemap for ' || site_id || '.' END AS response
  FROM written)"""

_R = "response"
_FENCED = duck_strip(f"regexp_extract({_R}, {sql_str(S.FENCE_RE)}, 1)")
_DECL = duck_strip(_strip_fences(duck_strip(f"regexp_extract({_R}, {sql_str(S.DECL_RE)}, 0)")))
_URLSET = _strip_fences(duck_strip(f"regexp_extract({_R}, {sql_str(S.URLSET_RE)}, 0)"))


@register("extract_xml", f"""
WITH {REPLIES_CTE}
SELECT file_id,
  CASE WHEN regexp_matches({_R}, {sql_str(S.FENCE_RE)}) THEN 'fenced'
       WHEN regexp_matches({_R}, {sql_str(S.DECL_RE)}) THEN 'declaration'
       WHEN regexp_matches({_R}, {sql_str(S.URLSET_RE)}) THEN 'urlset' ELSE 'raw' END AS branch,
  CASE WHEN regexp_matches({_R}, {sql_str(S.FENCE_RE)}) THEN {_with_decl(_FENCED)}
       WHEN regexp_matches({_R}, {sql_str(S.DECL_RE)}) THEN {_DECL}
       WHEN regexp_matches({_R}, {sql_str(S.URLSET_RE)}) THEN {_with_decl(_URLSET)}
       ELSE {_R} END AS xml
FROM replies""")
def q_extract_xml(spark, sf):
    r = replies(spark, sf)
    return r.select("file_id", S.extract_branch(F.col("response")).alias("branch"),
                    S.extract_xml(F.col("response")).alias("xml"))


@register("sitemap_parse_any_namespace", f"WITH {PARSE_CTE.replace('AND ns_ok', '')} SELECT * FROM structured UNION ALL SELECT * FROM fallback")
def q_sitemap_parse_any_namespace(spark, sf):
    return S.sitemap_parse(sitemap_docs(spark, sf), _KEYS, require_namespace=False)


@register("sitemap_write_chunked", f"""
WITH {WRITE_CTE.replace('CAST(0 AS BIGINT) AS chunk', 'CAST((row_number() OVER (PARTITION BY site_id ORDER BY pos) - 1) // 3 AS BIGINT) AS chunk')}
SELECT * FROM written""")
def q_sitemap_write_chunked(spark, sf):
    return S.sitemap_write(page_urls(spark, sf), max_urls=3)
