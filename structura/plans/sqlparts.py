"""DuckDB building blocks for the oracle twins (fixtures as CTEs)."""

from __future__ import annotations

from ..functions.url import duck_host, duck_segments
from ..sources.fixtures import CATALOG_HOST, ORDER_STRIDE


def slug(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g')"


def page_urls_cte(name: str = "urls") -> str:
    return (f"{name} AS (SELECT {duck_host('url')} AS site_id, page_id AS pos, url, "
            f"'' AS lastmod, '' AS changefreq, '' AS priority FROM pages)")


def catalog_cte(name: str = "urls", shorten: bool = False) -> str:
    segs = (f"[{slug('n_name')}, concat('s', l_suppkey), {slug('p_brand')}, {slug('p_type')}, "
            f"concat('p', l_partkey), concat('o', l_orderkey), concat('l', l_linenumber), 'detail']")
    if shorten:
        segs = f"list_slice({segs}, 1, 8 - (l_orderkey % 9))"
    return f"""{name} AS (
  SELECT {slug('r_name')} AS site_id,
         l_orderkey * {ORDER_STRIDE} + row_number() OVER (
             PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
         '{CATALOG_HOST}' || array_to_string({segs}, '/') AS url,
         '' AS lastmod, '' AS changefreq, '' AS priority
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""


def nodes_cte(src: str, name: str, max_depth: int | None) -> str:
    """Tree nodes with first_seen (T2) from a URL CTE ``src``."""
    cond = f"WHERE d - 1 <= {max_depth}" if max_depth is not None else ""
    return f"""{name}_pre AS (
  SELECT site_id, pos, array_to_string(segs[1:d], '/') AS path
  FROM (SELECT site_id, pos, segs, unnest(generate_series(1, len(segs))) AS d
        FROM (SELECT site_id, pos, {duck_segments('url')} AS segs FROM {src}))
  {cond}),
{name} AS (
  SELECT site_id, path,
         CASE WHEN len(string_split(path, '/')) > 1
              THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent_path,
         string_split(path, '/')[-1] AS name,
         CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth,
         min(pos) AS first_seen
  FROM {name}_pre GROUP BY site_id, path)"""


def ordered_cte(nodes: str, name: str) -> str:
    """Depth-first rank by the list of ancestors' first_seen."""
    return f"""{name}_anc AS (
  SELECT site_id, path, k,
         array_to_string(string_split(path, '/')[1:k], '/') AS a
  FROM (SELECT site_id, path, unnest(generate_series(1, depth + 1)) AS k FROM {nodes})),
{name}_sk AS (
  SELECT x.site_id, x.path, list(m.first_seen ORDER BY x.k) AS sort_key
  FROM {name}_anc x JOIN {nodes} m ON m.site_id = x.site_id AND m.path = x.a
  GROUP BY x.site_id, x.path),
{name} AS (
  SELECT n.*,
         row_number() OVER (PARTITION BY n.site_id ORDER BY s.sort_key) AS line_no,
         row_number() OVER (PARTITION BY n.site_id, n.parent_path ORDER BY n.first_seen) - 1 AS sibling_idx
  FROM {nodes} n JOIN {name}_sk s USING (site_id, path))"""


# --- questionnaire ingest twins ----------------------------------------------

def qa_source_cte(name: str = "qa") -> str:
    return f"""{name}_src AS (
  SELECT conv_id, turn, role, text AS question,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
  FROM conversations),
{name} AS (
  SELECT 'qfile-' || (conv_id // 20) AS file_id, conv_id // 20 AS file_no, conv_id, turn, question, answer
  FROM {name}_src WHERE role = 'user' AND next_role = 'assistant')"""


def qfiles_text_cte(name: str = "ftext", delim: str = ",") -> str:
    """The questionnaire CSV texts, built from conversations (twin of qfiles_text)."""
    def q(x):
        return f"""'"' || replace(coalesce({x}, ''), '"', '""') || '"'"""
    eol = "(CASE WHEN file_no % 4 = 1 THEN chr(13) || chr(10) ELSE chr(10) END)"
    return f"""{qa_source_cte('qa')},
{name}_recs AS (
  SELECT file_id, file_no, conv_id, turn,
         {q("'Conversation ' || conv_id")} || '{delim}' || {q('question')} || '{delim}' || {q('answer')} ||
         CASE WHEN file_no % 4 = 3 AND row_number() OVER (PARTITION BY file_id ORDER BY conv_id, turn) = 1
              THEN '{delim}"Acme Corp ' || file_id || '"' ELSE '' END || {eol} AS rec
  FROM qa),
{name} AS (
  SELECT file_id, CAST(file_no % 4 AS INTEGER) AS variant,
         'Client Name{delim}Acme ' || file_id || {eol} || {eol} ||
         CASE WHEN file_no % 4 = 3 THEN 'Section{delim}Question{delim}Answer{delim}Client Name'
              ELSE 'Section{delim}Question{delim}Answer' END
         || {eol} || string_agg(rec, '' ORDER BY conv_id, turn) AS text
  FROM {name}_recs GROUP BY file_id, file_no)"""


def doc_text_cte(name: str = "ftext") -> str:
    return f"{name} AS (SELECT 'doc-' || doc_id AS file_id, text FROM documents)"


def parse_chain_cte(src: str, name: str = "parsed") -> str:
    """The comma-dialect parse of ``src(file_id, text)`` with DuckDB lists and RE2."""
    from ..functions.text import NA_TOKENS, duck_strip, sql_list, sql_str
    # the twin's own patterns: RE2 runs in linear time and knows no possessive repeats
    quoted = r'"(?:[^"]|"")*"'
    field = rf'(?:{quoted}[^,\n"]*|"(?:[^"]|"")*\z|[^,"\n][^,\n]*)?'
    rec_re, cell_re = sql_str(rf"({field}(?:,{field})*)(?:\n|\z)"), sql_str(f",({field})")
    qre = sql_str(r'\A"((?:[^"]|"")*)"([^"]*)\z')
    unclosed = sql_str(rf'\A(?:(?:{quoted}[^,\n"]*|[^,"\n][^,\n]*)?,)*"(?:[^"]|"")*\z')
    cnt = "(length(l) - length(replace(l, ',', '')))"
    kw = "(contains(lower(l), 'section') OR contains(lower(l), 'question') OR contains(lower(l), 'answer'))"
    unq = (f"CASE WHEN regexp_matches(c, {qre}) THEN replace(regexp_extract(c, {qre}, 1), '\"\"', '\"') "
           f"|| regexp_extract(c, {qre}, 2) ELSE c END")
    return f"""{name}_0 AS (
  SELECT file_id, text, string_split(text, chr(10)) AS lines FROM {src}),
{name}_1 AS (
  SELECT *, list_position(list_transform(lines, lambda l: {kw} AND {cnt} >= 2), true) - 1 AS header_kw_line,
            list_position(list_transform(lines, lambda l: {cnt} >= 2), true) - 1 AS header_any_line
  FROM {name}_0),
{name}_2 AS (
  SELECT *, CAST(coalesce(header_kw_line, header_any_line, 0) AS INTEGER) AS header_line FROM {name}_1),
{name}_3 AS (
  SELECT *,
    (header_line > 0 AND len(list_filter(lines[header_line + 2:], lambda l: {duck_strip('l')} <> '')) = 0) AS no_data,
    list_transform(regexp_extract_all(array_to_string(lines[header_line + 1:], chr(10)), {rec_re}, 1),
                   lambda r: regexp_replace(r, '\\r\\z', '')) AS recs
  FROM {name}_2),
{name}_4 AS (
  SELECT *, list_filter(
      list_transform(recs, lambda r: {{'raw': r, 'cells': list_transform(regexp_extract_all(',' || r, {cell_re}, 1),
                                                                        lambda c: {unq})}}),
      lambda x: NOT (len(x.cells) = 1 AND {duck_strip('x.cells[1]')} = '')) AS nb
  FROM {name}_3),
{name}_5 AS (
  SELECT *, list_transform(coalesce(nb[1].cells, []::VARCHAR[]),
                           lambda x, i: CASE WHEN x = '' THEN 'Unnamed: ' || (i - 1) ELSE x END) AS named
  FROM {name}_4),
{name}_6 AS (
  SELECT *, list_transform(named, lambda x, i: CASE
      WHEN len(list_filter(named[1:i - 1], lambda y: y = x)) > 0
      THEN x || '.' || len(list_filter(named[1:i - 1], lambda y: y = x)) ELSE x END) AS hdr,
    CASE WHEN {duck_strip('text')} = '' THEN 'empty' WHEN no_data THEN 'no_data_after_header'
         WHEN len(nb) = 0 THEN 'no_columns' ELSE 'ok' END AS status
  FROM {name}_5),
{name}_7 AS (
  SELECT file_id, status, header_kw_line, header_any_line, header_line,
    CASE WHEN status = 'ok' THEN hdr END AS header,
    CASE WHEN status = 'ok' THEN list_transform(nb[2:], lambda x, i: {{
        'rec_no': CAST(i - 1 AS BIGINT), 'raw': x.raw,
        'cells': list_transform(x.cells, lambda c: CASE WHEN c IN {sql_list(NA_TOKENS)} THEN NULL ELSE c END),
        'reason': CASE WHEN regexp_matches(x.raw, {unclosed}) THEN 'unclosed_quote'
                       WHEN len(x.cells) > len(hdr) THEN 'too_many_fields' END}})
         ELSE [] END AS data
  FROM {name}_6),
{name} AS (
  SELECT *, list_transform(list_filter(data, lambda x: x.reason IS NULL), lambda x, i: {{
      'row_id': CAST(i - 1 AS BIGINT), 'rec_no': x.rec_no, 'cells': x.cells}}) AS rows
  FROM {name}_7)"""


def shop_cte(name: str = "urls") -> str:
    """Twin of fixtures.shop_urls."""
    from ..operators.rule_tables import LISTING_DETAIL
    from ..sources.fixtures import SHOP_LEGAL
    from ..functions.text import sql_str
    k = len(LISTING_DETAIL)
    lst = "[" + ", ".join(sql_str(a) for a, _ in LISTING_DETAIL) + f"][l_partkey % {k} + 1]"
    det = "[" + ", ".join(sql_str(b) for _, b in LISTING_DETAIL) + f"][l_partkey % {k} + 1]"
    legal = "[" + ", ".join(map(sql_str, SHOP_LEGAL)) + f"][l_orderkey % {len(SHOP_LEGAL)} + 1]"
    pt = slug("p_type")
    return f"""{name} AS (
  SELECT {slug('p_brand')} AS site_id, l_orderkey * {ORDER_STRIDE} + row_number() OVER (
             PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
         'https://' || {slug('p_brand')} || '.example.com' || CASE l_linenumber
           WHEN 1 THEN '/' || {lst}
           WHEN 2 THEN '/' || {lst} || '/' || {pt}
           WHEN 3 THEN '/' || {lst} || '/' || {pt} || '/p' || l_partkey
           WHEN 4 THEN CASE WHEN (l_partkey % {k}) % 2 = 0 THEN '/' || {lst} || '/' || {det} ELSE '/about' END
           WHEN 5 THEN '/'
           WHEN 6 THEN '/' || {legal}
           ELSE '/tag/' || {pt} END AS url,
         '' AS lastmod, '' AS changefreq, '' AS priority
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
