"""Queries for the site-structure rules V1-V12.

URL inputs: ``pages`` (query strings, language prefixes, style problems),
``shop_urls`` (listing pages, templates, legal pages, archives) and the
deep ``catalog_urls``.  Site-level facts the rules need (industry, traits,
languages) are derived from the same data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sql_list, sql_str
from ..functions.url import LEAD_C0_RE, UNSAFE_RE, duck_path, duck_segments
from ..operators import rule_tables as RT
from ..operators import rules as R
from ..operators.ingest import parse_files, qa_pairs
from ..sources.fixtures import catalog_urls, doc_files, page_urls, qfiles, shop_urls, variant_of
from .q_ingest import ALL_TEXT_CTE
from .registry import register
from .sqlparts import catalog_cte, page_urls_cte, parse_chain_cte, shop_cte

ANCHOR = "2025-01-01"
INDUSTRIES = sorted(RT.INDUSTRY_PAGES)
TRAITS = ["collects_data", "ecommerce", "eu_audience", "professional"]


# --- DuckDB expression twins -----------------------------------------------------
def _clean(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}, {sql_str(LEAD_C0_RE)}, '', 'g'), {sql_str(UNSAFE_RE)}, '', 'g')"


def _lang_free(segs: str) -> str:
    return (f"(CASE WHEN len({segs}) >= 2 AND regexp_matches({segs}[1], {sql_str(RT.LANG_CODE_RE)}) "
            f"THEN {segs}[2:] ELSE {segs} END)")


def _class_path(segs: str) -> str:
    return f"('/' || array_to_string({_lang_free(segs)}, '/'))"


def _class_case(cp: str, field: int, default) -> str:
    whens = " ".join(f"WHEN regexp_matches({cp}, {sql_str(r[1])}) THEN {sql_str(str(r[field]))}"
                     for r in RT.PAGE_CLASSES)
    return f"(CASE {whens} ELSE {sql_str(str(default))} END)"


def _priority(cp: str) -> str:
    return f"CAST({_class_case(cp, 2, RT.DEFAULT_CLASS[1])} AS DECIMAL(2,1))"


def _changefreq(cp: str) -> str:
    return _class_case(cp, 3, RT.DEFAULT_CLASS[2])


def _lastmod(url: str, cp: str) -> str:
    w = f"CAST({_class_case(cp, 4, RT.DEFAULT_CLASS[3])} AS INTEGER)"
    h = f"CAST(('0x' || substr(md5({url}), 1, 8)) AS BIGINT)"
    return (f"(CASE WHEN {w} = 0 THEN DATE '{ANCHOR}' "
            f"ELSE CAST(DATE '{ANCHOR}' - CAST({h} % {w} AS INTEGER) AS DATE) END)")


def _paths_cte(src: str, name: str = "paths") -> str:
    return f"""{name} AS (
  SELECT DISTINCT site_id, array_to_string(segs, '/') AS seg_path, segs
  FROM (SELECT site_id, {duck_segments('url')} AS segs FROM {src}))"""


def _segments_by_reason() -> dict[str, list[str]]:
    by_reason: dict[str, list[str]] = {}
    for seg, reason in RT.EXCLUDED_SEGMENTS.items():
        by_reason.setdefault(reason, []).append(seg)
    return by_reason


# --- V1 -------------------------------------------------------------------------
def _exclude_sql(src: str, approach: str = RT.ML_DEFAULT) -> str:
    conds = []
    for reason, segs in _segments_by_reason().items():
        conds.append((reason, f"len(list_filter(segs, lambda s: s IN {sql_list(segs)})) > 0"))
    params = "list_filter(string_split(query, '&'), lambda p: p <> '')"
    conds += [
        ("search", f"len(list_filter({params}, lambda p: starts_with(p, 'q='))) > 0"),
        ("filter", f"len(list_filter({params}, lambda p: NOT starts_with(p, 'q=') "
                   f"AND NOT regexp_full_match(p, 'page=[0-9]+'))) > 0"),
        ("pagination", f"(len(list_filter({params}, lambda p: regexp_full_match(p, 'page=[0-9]+'))) > 0 "
                       f"OR regexp_matches(array_to_string(segs, '/'), {sql_str(RT.PAGINATION_RE)}))"),
    ]
    if approach != "subdirectory":
        conds.append(("language_prefix",
                      f"(len(segs) = 1 AND regexp_matches(segs[1], {sql_str(RT.LANG_CODE_RE)}))"))
    base = (f"SELECT site_id, pos, url, {duck_segments('url')} AS segs, "
            f"regexp_extract({_clean('url')}, {sql_str(R.QUERY_RE)}, 1) AS query FROM {src}")
    parts = [f"SELECT site_id, pos, url, 'exclude' AS rule, {sql_str(r)} AS detail FROM ex WHERE {c}"
             for r, c in conds]
    return f"ex AS ({base})\n" + "\nUNION ALL ".join(parts)


@register("rule_exclude", f"WITH {page_urls_cte()}, {_exclude_sql('urls')}")
def q_rule_exclude(spark, sf):
    return R.rule_exclude(page_urls(spark, sf))


# --- V2 / V3 --------------------------------------------------------------------
_LD_CASE = "CASE segs[-1] " + " ".join(f"WHEN {sql_str(a)} THEN {sql_str(b)}" for a, b in RT.LISTING_DETAIL) + " END"


@register("rule_listing_detail", f"""
WITH {shop_cte()}, {_paths_cte('urls')},
listing AS (SELECT site_id, seg_path, seg_path || '/' || {_LD_CASE} AS expected
            FROM paths WHERE len(segs) > 0 AND {_LD_CASE} IS NOT NULL)
SELECT site_id, '/' || seg_path AS url, 'listing_detail' AS rule, 'missing /' || expected AS detail
FROM listing l
WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.site_id = l.site_id AND p.seg_path = l.expected)""")
def q_rule_listing_detail(spark, sf):
    return R.rule_listing_detail(shop_urls(spark, sf))


def _hier_sql() -> str:
    return f"""
hp AS (SELECT *, len(segs) AS n FROM paths),
orph AS (SELECT site_id, seg_path, array_to_string(segs[1:n - 1], '/') AS parent FROM hp WHERE n >= 2)
SELECT site_id, '/' || seg_path AS url, 'hierarchy' AS rule, 'orphan: missing /' || parent AS detail
FROM orph o WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.site_id = o.site_id AND p.seg_path = o.parent)
UNION ALL
SELECT site_id, '/' || seg_path, 'hierarchy', 'too_deep: ' || n || ' levels' FROM hp WHERE n > {RT.MAX_LEVELS}"""


@register("rule_hierarchy", f"WITH {catalog_cte(shorten=True)}, {_paths_cte('urls')}," + _hier_sql())
def q_rule_hierarchy(spark, sf):
    return R.rule_hierarchy(catalog_urls(spark, sf, shorten=True))


@register("rule_hierarchy_shop", f"WITH {shop_cte()}, {_paths_cte('urls')}," + _hier_sql())
def q_rule_hierarchy_shop(spark, sf):
    return R.rule_hierarchy(shop_urls(spark, sf))


# --- V4 / V5 --------------------------------------------------------------------
def _site_industry(spark, sf):
    sites = page_urls(spark, sf).select("site_id").distinct()
    pick = F.get(F.array(*map(F.lit, INDUSTRIES)), variant_of(F.col("site_id"), len(INDUSTRIES)).cast("int"))
    return sites.select("site_id", pick.alias("industry"))


def _site_traits(spark, sf):
    sites = page_urls(spark, sf).select("site_id").distinct()
    h = F.md5(F.col("site_id"))
    return sites.select("site_id", *[(F.ascii(F.substring(h, i + 3, 1)) % 2 == 0).alias(t)
                                     for i, t in enumerate(TRAITS)])


_VARIANT = "((ascii(substr(md5(site_id), 1, 1)) * 7 + ascii(substr(md5(site_id), 2, 1))) % {n})"
_CLASS_PATHS = f"""cpaths AS (
  SELECT DISTINCT site_id, substr({_class_path('segs')}, 2) AS path
  FROM (SELECT site_id, {duck_segments('url')} AS segs FROM urls))"""
_IND_VALUES = ", ".join(f"({sql_str(i)}, {sql_str(p)})" for i, ps in RT.INDUSTRY_PAGES.items() for p in ps)


@register("rule_industry", f"""
WITH {page_urls_cte()}, {_CLASS_PATHS},
sites AS (SELECT DISTINCT site_id FROM urls),
si AS (SELECT site_id,
              {'[' + ', '.join(map(sql_str, INDUSTRIES)) + ']'}[{_VARIANT.format(n=len(INDUSTRIES))} + 1] AS industry
       FROM sites),
it(industry, path) AS (VALUES {_IND_VALUES}),
expected AS (SELECT si.site_id, it.path, it.industry AS why FROM si JOIN it USING (industry))
SELECT site_id, '/' || path AS url, 'industry' AS rule, why AS detail FROM expected e
WHERE NOT EXISTS (SELECT 1 FROM cpaths c WHERE c.site_id = e.site_id AND c.path = e.path)""")
def q_rule_industry(spark, sf):
    return R.rule_industry(page_urls(spark, sf), _site_industry(spark, sf))


_LEGAL_VALUES = ", ".join(f"({sql_str(t)}, {sql_str(p)})" for t, p in RT.LEGAL_PAGES)
_TRAIT_ROWS = "\n  UNION ALL ".join(
    f"SELECT site_id, {sql_str(t)} AS trait FROM sites WHERE ascii(substr(md5(site_id), {i + 3}, 1)) % 2 = 0"
    for i, t in enumerate(TRAITS))


@register("rule_legal", f"""
WITH {page_urls_cte()}, {_CLASS_PATHS},
sites AS (SELECT DISTINCT site_id FROM urls),
st AS ({_TRAIT_ROWS}),
lt(trait, path) AS (VALUES {_LEGAL_VALUES}),
expected AS (SELECT site_id, path, array_to_string(list_sort(list_distinct(list(trait))), ',') AS why
             FROM st JOIN lt USING (trait) GROUP BY site_id, path)
SELECT site_id, '/' || path AS url, 'legal' AS rule, why AS detail FROM expected e
WHERE NOT EXISTS (SELECT 1 FROM cpaths c WHERE c.site_id = e.site_id AND c.path = e.path)""")
def q_rule_legal(spark, sf):
    return R.rule_legal(page_urls(spark, sf), _site_traits(spark, sf))


# --- V6 -------------------------------------------------------------------------
def _site_langs(spark, sf):
    u = R.with_paths(page_urls(spark, sf))
    return (u.filter((F.size("segs") >= 2) & F.get(F.col("segs"), 0).rlike(RT.LANG_CODE_RE))
            .select("site_id", F.get(F.col("segs"), 0).alias("lang")).distinct())


_ML_SQL = f"""
WITH {page_urls_cte()},
p AS (SELECT site_id, pos, {_class_path('segs')} AS class_path, segs,
             regexp_extract({_clean('url')}, {sql_str(R.HOST_PART_RE)}, 1) AS host
      FROM (SELECT site_id, pos, url, {duck_segments('url')} AS segs FROM urls)),
langs AS (SELECT DISTINCT site_id, segs[1] AS lang FROM p
          WHERE len(segs) >= 2 AND regexp_matches(segs[1], {sql_str(RT.LANG_CODE_RE)})),
pages AS (SELECT site_id, class_path, min(pos) AS pos, arg_min(host, pos) AS host FROM p GROUP BY site_id, class_path)
SELECT site_id, pos, lang, class_path AS path, @url@ AS url FROM pages JOIN langs USING (site_id)"""


@register("rule_multilingual", _ML_SQL.replace("@url@", f"host || class_path || '?{RT.ML_PARAM}=' || lang"))
def q_rule_multilingual(spark, sf):
    return R.rule_multilingual(page_urls(spark, sf), _site_langs(spark, sf))


@register("rule_multilingual_subdirectory", _ML_SQL.replace("@url@", "host || '/' || lang || class_path"))
def q_rule_multilingual_subdirectory(spark, sf):
    return R.rule_multilingual(page_urls(spark, sf), _site_langs(spark, sf), "subdirectory")


@register("rule_multilingual_subdomain", _ML_SQL.replace("@url@", "replace(host, '://', '://' || lang || '.') || class_path"))
def q_rule_multilingual_subdomain(spark, sf):
    return R.rule_multilingual(page_urls(spark, sf), _site_langs(spark, sf), "subdomain")


# --- V7 / V8 / V9 ---------------------------------------------------------------
_APPLY = f"""
a AS (SELECT site_id, pos, url, {_class_path('segs')} AS cp
      FROM (SELECT site_id, pos, url, {duck_segments('url')} AS segs FROM urls))"""


@register("rule_priority", f"""
WITH {shop_cte()}, {_APPLY}
SELECT site_id, pos, url, {_class_case('cp', 0, RT.DEFAULT_CLASS[0])} AS page_class, {_priority('cp')} AS priority
FROM a""")
def q_rule_priority(spark, sf):
    return R.apply_rules(shop_urls(spark, sf), ANCHOR).select("site_id", "pos", "url", "page_class", "priority")


@register("rule_changefreq", f"""
WITH {shop_cte()}, {_APPLY}
SELECT site_id, pos, url, {_changefreq('cp')} AS changefreq FROM a""")
def q_rule_changefreq(spark, sf):
    return R.apply_rules(shop_urls(spark, sf), ANCHOR).select("site_id", "pos", "url", "changefreq")


@register("rule_lastmod", f"""
WITH {shop_cte()}, {_APPLY}
SELECT site_id, pos, url, {_lastmod('url', 'cp')} AS lastmod FROM a""")
def q_rule_lastmod(spark, sf):
    return R.apply_rules(shop_urls(spark, sf), ANCHOR).select("site_id", "pos", "url", "lastmod")


# --- V10 ------------------------------------------------------------------------
def _lint_sql(url: str) -> str:
    path, segs = duck_path(url), duck_segments(url)
    checks = [
        ("uppercase", f"regexp_matches({path}, '[A-Z]')"),
        ("underscore", f"contains({path}, '_')"),
        ("special_chars", f"regexp_matches({path}, {sql_str(r'[^A-Za-z0-9/_\-]')})"),
        ("leading_digit", f"len(list_filter({segs}, lambda s: regexp_matches(s, '^[0-9]'))) > 0"),
        ("double_slash", f"contains({path}, '//')"),
        ("too_deep", f"len({segs}) > {RT.LINT_MAX_DEPTH}"),
        ("too_long", f"length({url}) > {RT.LINT_MAX_LENGTH}"),
        ("trailing_slash", f"({path} <> '/' AND ends_with({path}, '/'))"),
    ]
    return ("list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks)
            + "], lambda x: x IS NOT NULL)")


_LINT = f"lint AS (SELECT site_id, pos, url, {_lint_sql('url')} AS violations FROM urls)"


@register("rule_url_lint", f"""
WITH {page_urls_cte()}, {_LINT}
SELECT * FROM lint WHERE len(violations) > 0""")
def q_rule_url_lint(spark, sf):
    return R.rule_url_lint(page_urls(spark, sf))


@register("rule_url_lint_summary", f"""
WITH {page_urls_cte()}, {_LINT}
SELECT site_id, violation, count(*) AS n_urls
FROM (SELECT site_id, unnest(violations) AS violation FROM lint) GROUP BY site_id, violation""")
def q_rule_url_lint_summary(spark, sf):
    return R.url_lint_summary(page_urls(spark, sf))


# --- V11 ------------------------------------------------------------------------
def _records(spark, sf):
    """Shop and page URLs with V7-V9 values as text, perturbed by an md5
    variant of the URL: 1 wrong priority, 2 unknown changefreq, 3 no lastmod."""
    u = shop_urls(spark, sf).unionByName(page_urls(spark, sf))
    a = R.apply_rules(u, ANCHOR)
    v = variant_of(F.col("url"), 5)
    return a.select("site_id", "pos", "url",
                    F.when(v == 3, F.lit("")).otherwise(F.col("lastmod").cast("string")).alias("lastmod"),
                    F.when(v == 2, F.lit("sometimes")).otherwise(F.col("changefreq")).alias("changefreq"),
                    F.when(v == 1, F.lit("1.0")).otherwise(F.col("priority").cast("string")).alias("priority"))


_UVAR = "((ascii(substr(md5(url), 1, 1)) * 7 + ascii(substr(md5(url), 2, 1))) % 5)"
_REC_CTE = f"""{shop_cte('shop')}, {page_urls_cte('pg')},
u0 AS (SELECT * FROM shop UNION ALL SELECT * FROM pg),
a0 AS (SELECT site_id, pos, url, {_class_path('segs')} AS cp
       FROM (SELECT site_id, pos, url, {duck_segments('url')} AS segs FROM u0)),
urls AS (
  SELECT site_id, pos, url,
         CASE WHEN {_UVAR} = 3 THEN '' ELSE CAST({_lastmod('url', 'cp')} AS VARCHAR) END AS lastmod,
         CASE WHEN {_UVAR} = 2 THEN 'sometimes' ELSE {_changefreq('cp')} END AS changefreq,
         CASE WHEN {_UVAR} = 1 THEN '1.0' ELSE CAST({_priority('cp')} AS VARCHAR) END AS priority
  FROM a0)"""


# the twin looks up every prefix of every path and takes the longest that is a page
_ORDER_CTE = """
pp AS (SELECT site_id, seg_path, max(CASE WHEN prio >= 0 AND prio <= 1 THEN prio END) AS top
       FROM (SELECT site_id, array_to_string(segs, '/') AS seg_path, TRY_CAST(priority AS DECIMAL(2,1)) AS prio
             FROM (SELECT site_id, priority, @segs@ AS segs FROM urls)) GROUP BY site_id, seg_path),
up AS (SELECT site_id, seg_path, top, unnest(list_transform(range(0, CASE WHEN seg_path = '' THEN 0 ELSE len(string_split(seg_path, '/')) END),
              lambda k: array_to_string(string_split(seg_path, '/')[1:k], '/'))) AS anc FROM pp),
near AS (SELECT u.site_id, u.seg_path, any_value(u.top) AS top, max_by(a.seg_path, length(a.seg_path)) AS anc, max(length(a.seg_path)) AS n
         FROM up AS u JOIN pp AS a ON a.site_id = u.site_id AND a.seg_path = u.anc GROUP BY u.site_id, u.seg_path),
outranked AS (SELECT n.site_id, '/' || n.seg_path AS url, 'priority_order' AS rule,
                     CAST(n.top AS VARCHAR) || ' above ' || CAST(a.top AS VARCHAR) || ' of /' || a.seg_path AS detail
              FROM near AS n JOIN pp AS a ON a.site_id = n.site_id AND a.seg_path = n.anc WHERE n.top > a.top)""".replace("@segs@", duck_segments("url"))


@register("rule_priority_order", f"WITH {_REC_CTE}, {_ORDER_CTE} SELECT * FROM outranked")
def q_rule_priority_order(spark, sf):
    return R.rule_priority_order(_records(spark, sf))


def _site_pages(spark, sf):
    sites = page_urls(spark, sf).select("site_id").distinct()
    return sites.select("site_id", (variant_of(F.col("site_id"), 5) * 100).cast("bigint").alias("pages"))


_FACTS_CTE = f"""{_CLASS_PATHS},
sites AS (SELECT DISTINCT site_id FROM pg),
si AS (SELECT site_id,
              {'[' + ', '.join(map(sql_str, INDUSTRIES)) + ']'}[{_VARIANT.format(n=len(INDUSTRIES))} + 1] AS industry
       FROM sites),
it(industry, path) AS (VALUES {_IND_VALUES}),
st AS ({_TRAIT_ROWS}),
lt(trait, path) AS (VALUES {_LEGAL_VALUES}),
expected_all AS (
  SELECT si.site_id, it.path, 'industry' AS rule, it.industry AS why FROM si JOIN it USING (industry)
  UNION ALL
  SELECT site_id, path, 'legal', array_to_string(list_sort(list_distinct(list(trait))), ',') FROM st JOIN lt USING (trait) GROUP BY site_id, path),
lp AS (SELECT site_id, pos, {_class_path('segs')} AS class_path, segs, regexp_extract({_clean('url')}, {sql_str(R.HOST_PART_RE)}, 1) AS host
       FROM (SELECT site_id, pos, url, {duck_segments('url')} AS segs FROM urls)),
langs AS (SELECT DISTINCT site_id, segs[1] AS lang FROM (SELECT site_id, {duck_segments('url')} AS segs FROM pg)
          WHERE len(segs) >= 2 AND regexp_matches(segs[1], {sql_str(RT.LANG_CODE_RE)})),
lpages AS (SELECT site_id, class_path, arg_min(host, pos) AS host FROM lp GROUP BY site_id, class_path),
wanted AS (SELECT site_id, lang, host || class_path || '?{RT.ML_PARAM}=' || lang AS url FROM lpages JOIN langs USING (site_id))"""


@register("sitemap_validate", f"""
WITH {_REC_CTE}, {_paths_cte('urls')}, {_LINT}, {_ORDER_CTE}, {_FACTS_CTE},
v AS (SELECT site_id, url, {_class_path(duck_segments('url'))} AS cp,
             TRY_CAST(priority AS DECIMAL(2,1)) AS prio, priority, changefreq, lastmod FROM urls),
{_exclude_sql('urls')}
UNION ALL
SELECT site_id, url, 'duplicate', count(*) || ' copies' FROM urls GROUP BY site_id, url HAVING count(*) > 1
UNION ALL
SELECT site_id, NULL, 'lastmod_not_varied', count(*) || ' URLs, one date' FROM urls GROUP BY site_id
HAVING count(*) > 1 AND count(DISTINCT lastmod) <= 1
UNION ALL
SELECT site_id, url, 'invalid_priority', priority FROM v WHERE prio IS NULL OR prio < 0 OR prio > 1
UNION ALL
SELECT site_id, url, 'priority', 'expected ' || CAST({_priority('cp')} AS VARCHAR) || ' got ' || CAST(prio AS VARCHAR)
FROM v WHERE NOT (prio IS NULL OR prio < 0 OR prio > 1) AND prio <> {_priority('cp')}
UNION ALL
SELECT site_id, url, 'invalid_changefreq', changefreq FROM v WHERE changefreq NOT IN {sql_list(RT.CHANGEFREQ_VALUES)}
UNION ALL
SELECT site_id, url, 'changefreq', 'expected ' || {_changefreq('cp')} || ' got ' || changefreq
FROM v WHERE changefreq IN {sql_list(RT.CHANGEFREQ_VALUES)} AND changefreq <> {_changefreq('cp')}
UNION ALL
SELECT site_id, url, 'invalid_lastmod', lastmod FROM v WHERE TRY_STRPTIME(lastmod, '%Y-%m-%d') IS NULL
UNION ALL
SELECT site_id, '/' || seg_path, 'listing_detail', 'missing /' || expected
FROM (SELECT site_id, seg_path, seg_path || '/' || {_LD_CASE} AS expected
      FROM paths WHERE len(segs) > 0 AND {_LD_CASE} IS NOT NULL) l
WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.site_id = l.site_id AND p.seg_path = l.expected)
UNION ALL
SELECT * FROM ({_hier_sql().replace('hp AS', 'WITH hp AS', 1)})
UNION ALL
SELECT site_id, url, 'url_style', unnest(violations) FROM lint
UNION ALL
SELECT * FROM outranked
UNION ALL
SELECT site_id, '/' || path, rule, why FROM expected_all e
WHERE NOT EXISTS (SELECT 1 FROM cpaths c WHERE c.site_id = e.site_id AND c.path = e.path)
UNION ALL
SELECT site_id, NULL, 'multilingual', lang || ': ' || count(*) || ' pages missing' FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM urls u WHERE u.site_id = w.site_id AND u.url = w.url) GROUP BY site_id, lang
UNION ALL
SELECT site_id, NULL, 'page_count', 'expected ' || pages || ' got ' || n
FROM (SELECT s.site_id, {_VARIANT.format(n=5).replace('site_id', 's.site_id')} * 100 AS pages,
             (SELECT count(*) FROM urls u WHERE u.site_id = s.site_id) AS n FROM sites s) WHERE n < pages""".replace(
    "SELECT site_id, pos, url, 'exclude' AS rule", "SELECT site_id, url, 'exclude' AS rule"))
def q_sitemap_validate(spark, sf):
    # A dozen finding branches read the records: write them once to the shared
    # checkpoint folder instead of re-running the lineitem x part join per branch.
    from ..functions.scratch import materialize
    return R.sitemap_validate(materialize(_records(spark, sf), "validate-input"), site_industry=_site_industry(spark, sf),
                              site_traits=_site_traits(spark, sf), site_langs=_site_langs(spark, sf), expected_pages=_site_pages(spark, sf))


# --- V12 ------------------------------------------------------------------------
def _pairs(spark, sf):
    return qa_pairs(parse_files(qfiles(spark, sf).unionByName(doc_files(spark, sf))))


_KW_VALUES = ", ".join(f"({sql_str(t)}, {sql_str(s)}, {sql_str(v)})"
                       for t, (s, v) in sorted(RT.PROFILE_KEYWORDS.items()))
_LEGAL_CASE = "CASE t " + " ".join(
    f"WHEN {sql_str(t)} THEN {'[' + ', '.join(sql_str(p) for t2, p in RT.LEGAL_PAGES if t2 == t) + ']'}"
    for t in dict.fromkeys(t for t, _ in RT.LEGAL_PAGES)) + " ELSE []::VARCHAR[] END"


def _pairs_cte() -> str:
    from .q_ingest import _roles_sql
    from ..functions.text import duck_strip
    return ALL_TEXT_CTE + ",\n" + parse_chain_cte("ftext") + "," + _roles_sql() + f""",
pairs AS (
  SELECT file_id, r.row_id + 1 AS id, {duck_strip('r.cells[q_idx + 1]')} AS question,
         {duck_strip('r.cells[a_idx + 1]')} AS answer
  FROM (SELECT file_id, q_idx, a_idx, unnest(rows) AS r FROM roles)
  WHERE coalesce(r.cells[q_idx + 1], '') <> '' AND coalesce(r.cells[a_idx + 1], '') <> ''
    AND {duck_strip('r.cells[q_idx + 1]')} <> '' AND {duck_strip('r.cells[a_idx + 1]')} <> '')"""


PROFILE_SQL = f"""
kw(token, signal, value) AS (VALUES {_KW_VALUES}),
toks AS (SELECT file_id, id, unnest(list_distinct(regexp_split_to_array(lower(concat_ws(' ', question, answer)),
                                                                        {sql_str(RT.TOKEN_SPLIT_RE)}))) AS token
         FROM pairs),
hits AS (SELECT file_id, signal, value, count(DISTINCT id) AS n FROM toks JOIN kw USING (token)
         WHERE token <> '' GROUP BY file_id, signal, value),
pf AS (SELECT file_id,
              first(value ORDER BY n DESC, value) FILTER (WHERE signal = 'business_type') AS bt,
              list_sort(list(DISTINCT value) FILTER (WHERE signal = 'dynamic')) AS dyn,
              list_sort(list(DISTINCT value) FILTER (WHERE signal = 'trait')) AS tr
       FROM hits GROUP BY file_id),
base AS (SELECT file_id, count(*) AS n_pairs FROM pairs GROUP BY file_id),
j AS (SELECT b.file_id, b.n_pairs, coalesce(bt, 'general') AS business_type,
             coalesce(dyn, []::VARCHAR[]) AS dynamic_types, coalesce(tr, []::VARCHAR[]) AS tr0
      FROM base b LEFT JOIN pf USING (file_id)),
j2 AS (SELECT *, (business_type = 'ecommerce' OR list_contains(tr0, 'ecommerce')) AS ecommerce FROM j),
j3 AS (SELECT *, list_sort(list_distinct(tr0 || CASE WHEN ecommerce THEN ['ecommerce'] ELSE []::VARCHAR[] END))
                 AS traits FROM j2),
profile AS (
  SELECT file_id, business_type, dynamic_types, ecommerce, list_contains(traits, 'multilingual') AS multilingual,
         traits, list_sort(list_distinct(flatten(list_transform(traits, lambda t: {_LEGAL_CASE})))) AS legal_pages,
         n_pairs
  FROM j3)"""


@register("questionnaire_profile", f"WITH {_pairs_cte()}, {PROFILE_SQL} SELECT * FROM profile")
def q_questionnaire_profile(spark, sf):
    return R.questionnaire_profile(_pairs(spark, sf))


# the twin looks for another keyword of the value in every file, and takes logarithms of ratios written out
WEIGHTS_SQL = f"""
kw(token, signal, value) AS (VALUES {_KW_VALUES}),
held AS (SELECT p.file_id, k.token, k.signal, k.value, count(DISTINCT p.id) AS n
         FROM (SELECT file_id, id, unnest(regexp_split_to_array(lower(concat_ws(' ', question, answer)), {sql_str(RT.TOKEN_SPLIT_RE)})) AS token FROM pairs) AS p
         JOIN kw AS k USING (token) GROUP BY ALL),
files AS (SELECT file_id, count(*) AS n_pairs FROM pairs GROUP BY file_id),
seen AS (SELECT k.token, k.signal, k.value, (SELECT count(*) FROM files) AS total,
                count(DISTINCT h.file_id) FILTER (WHERE h.token = k.token) AS n_files,
                count(DISTINCT h.file_id) FILTER (WHERE h.token <> k.token) AS others,
                count(DISTINCT h.file_id) FILTER (WHERE h.token <> k.token AND own.file_id IS NOT NULL) AS n_backed
         FROM kw AS k LEFT JOIN held AS h ON h.signal = k.signal AND h.value = k.value
         LEFT JOIN held AS own ON own.file_id = h.file_id AND own.token = k.token GROUP BY k.token, k.signal, k.value),
shares AS (SELECT *, (n_files + 0.5::DOUBLE) / (total + 1) AS share FROM seen),
weights AS (SELECT token, signal, value, n_files, n_backed,
                   CAST(round(1000000 * greatest(0, ln((total + 1)::DOUBLE / (n_files + 1))
                     + ln((n_backed + share) * (1 - share) / ((others - n_backed + 1 - share) * share)))) AS BIGINT) AS weight
            FROM shares)"""


@register("evidence_weights", f"WITH {_pairs_cte()}, {WEIGHTS_SQL} SELECT * FROM weights")
def q_evidence_weights(spark, sf):
    return R.evidence_weights(_keyword_counts(spark, sf))


def _keyword_counts(spark, sf):
    # the weights and the profile read the counts: the questionnaires are parsed once
    from ..functions.scratch import materialize
    return materialize(R.keyword_counts(_pairs(spark, sf)), "keyword-counts")


@register("questionnaire_profile_weighted", f"""
WITH {_pairs_cte()}, {WEIGHTS_SQL},
told AS (SELECT file_id, signal, value, sum(n * weight) AS e FROM held JOIN weights USING (token, signal, value)
         GROUP BY file_id, signal, value HAVING sum(n * weight) >= 693147),
kinds AS (SELECT file_id, value, e FROM told WHERE signal = 'business_type'
          QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY e DESC, value) = 1),
lists AS (SELECT file_id, list_sort(list(value) FILTER (WHERE signal = 'dynamic')) AS dyn, list(value) FILTER (WHERE signal = 'trait') AS tr
          FROM told GROUP BY file_id),
joined AS (SELECT f.file_id, f.n_pairs, coalesce(k.value, 'general') AS business_type, coalesce(k.e, 0) AS evidence,
                  coalesce(l.dyn, []::VARCHAR[]) AS dynamic_types,
                  list_sort(list_distinct(coalesce(l.tr, []::VARCHAR[]) || CASE WHEN k.value = 'ecommerce' THEN ['ecommerce'] ELSE []::VARCHAR[] END)) AS traits
           FROM files AS f LEFT JOIN kinds AS k USING (file_id) LEFT JOIN lists AS l USING (file_id))
SELECT file_id, business_type, dynamic_types, list_contains(traits, 'ecommerce') AS ecommerce, list_contains(traits, 'multilingual') AS multilingual,
       traits, list_sort(list_distinct(flatten(list_transform(traits, lambda t: {_LEGAL_CASE})))) AS legal_pages, n_pairs, CAST(evidence AS BIGINT) AS evidence
FROM joined""")
def q_questionnaire_profile_weighted(spark, sf):
    counts = _keyword_counts(spark, sf)
    return R.weighted_profile(counts, R.evidence_weights(counts))


_NEGATIONS = "[" + ", ".join(map(sql_str, RT.NEGATIONS)) + "]"
# the twin takes every shingle of every pair, and every longer one that covers it
MENTIONED_SQL = f"""
phrases(phrase, value, n) AS (VALUES {', '.join(f"({sql_str(p)}, {sql_str(v)}, {len(p.split())})" for p, v in
                                                [*RT.PAGE_PHRASES.items(), *((p, '=' + a) for p, a in RT.APPROACH_PHRASES.items())])}),
parts AS (SELECT file_id, id, {", ".join(
    f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[.!?;' || chr(10) || ']+', ' . ', 'g'), '[^\\p{{L}}\\p{{N}}.'']+'), lambda w: w <> '') AS {c[0]}"
    for c in ("question", "answer"))} FROM pairs),
spoken AS (SELECT file_id, id, len(q) AS nq, coalesce(list_contains({_NEGATIONS}, a[1]), false) AS refused, q || ['.'] || a AS w FROM parts),
shingles AS (SELECT file_id, id, nq, refused, w, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase
             FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM spoken), (VALUES (1), (2), (3)) AS t(n) WHERE k + n - 1 <= len(w)),
found AS (SELECT s.*, p.value FROM shingles AS s JOIN phrases AS p ON p.phrase = s.phrase AND p.n = s.n),
said AS (SELECT DISTINCT file_id, id, value FROM found AS f
  WHERE NOT EXISTS (SELECT 1 FROM found AS g WHERE g.file_id = f.file_id AND g.id = f.id AND g.n > f.n AND g.k <= f.k AND g.k + g.n >= f.k + f.n)
    AND NOT (refused AND k <= nq)
    AND NOT (list_contains({_NEGATIONS}, w[k - 1]) OR (k > 2 AND w[k - 1] <> '.' AND list_contains({_NEGATIONS}, w[k - 2]))
             OR (k > 3 AND w[k - 1] <> '.' AND w[k - 2] <> '.' AND list_contains({_NEGATIONS}, w[k - 3]))))"""
