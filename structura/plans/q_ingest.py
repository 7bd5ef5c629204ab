"""Queries for I1-I11, R1-R5 and S5 over questionnaire files built from
``conversations`` (clean, with an independent round-trip truth) and from
``documents`` (irregular prose read as CSV)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import NA_TOKENS, duck_strip, sql_list, sql_str
from ..operators import ingest as I
from ..sources.fixtures import LATIN1_RE, doc_files, qfiles
from .registry import register
from .sqlparts import doc_text_cte, parse_chain_cte, qa_source_cte, qfiles_text_cte

RUN_TS = "2025-01-01 12:00:00"     # fixed run time for output names
SEP = "\u001f"                      # cell separator in text renderings of arrays


def _cells_text(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("<null>"))), SEP)


def _duck_cells_text(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: coalesce(x, '<null>')), chr(31))"


def _all_files(spark, sf):
    return qfiles(spark, sf).unionByName(doc_files(spark, sf))


ENCODING_SQL = (f"CASE WHEN variant = 2 AND regexp_matches(text, '[^\\x{{0}}-\\x{{7F}}]') "
                f"AND regexp_matches(text, {sql_str(LATIN1_RE)}) THEN 'ISO-8859-1' ELSE 'UTF-8' END")
ALL_TEXT_CTE = (qfiles_text_cte("qtext") + ",\n" + doc_text_cte("dtext") + f""",
ftext AS (
  SELECT file_id, text, {ENCODING_SQL} AS encoding FROM qtext
  UNION ALL SELECT file_id, text, 'UTF-8' AS encoding FROM dtext)""")


@register("ingest_decode", f"""
WITH {qfiles_text_cte()}
SELECT file_id, {ENCODING_SQL} AS encoding, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5
FROM ftext""")
def q_ingest_decode(spark, sf):
    d = I.decode(qfiles(spark, sf))
    return d.select("file_id", "encoding", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("header_discovery", f"""
WITH {doc_text_cte()}, {parse_chain_cte('ftext')}
SELECT file_id, CAST(header_kw_line AS INTEGER) AS header_kw_line,
       CAST(header_any_line AS INTEGER) AS header_any_line, header_line FROM parsed""")
def q_header_discovery(spark, sf):
    return I.parse_files(doc_files(spark, sf)).select("file_id", "header_kw_line", "header_any_line",
                                                      "header_line")


# The clean files have an independent truth: the records and rows as written.
_Q = """'"' || replace(coalesce({x}, ''), '"', '""') || '"'"""
_REC = " || ',' || ".join(_Q.format(x=x) for x in ("'Conversation ' || conv_id", "question", "answer"))
ROWS_CTE = f"""{qa_source_cte()},
truth AS (
  SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY conv_id, turn) - 1 AS BIGINT) AS row_id,
         file_no % 4 = 3 AND row_number() OVER (PARTITION BY file_id ORDER BY conv_id, turn) = 1 AS has_client,
         conv_id, turn, question, answer, {_REC} AS rec
  FROM qa)"""
_NA = sql_list(NA_TOKENS)


def _na(x: str) -> str:
    return f"CASE WHEN {x} IN {_NA} THEN NULL ELSE {x} END"


@register("record_assembly", f"""
WITH {ROWS_CTE}
SELECT file_id, row_id AS rec_no,
       rec || CASE WHEN has_client THEN ',"Acme Corp ' || file_id || '"' ELSE '' END AS raw
FROM truth""")
def q_record_assembly(spark, sf):
    return I.records(I.parse_files(qfiles(spark, sf)))


@register("record_assembly_docs", f"""
WITH {doc_text_cte()}, {parse_chain_cte('ftext')}
SELECT file_id, r.rec_no, r.raw FROM (SELECT file_id, unnest(data) AS r FROM parsed)""")
def q_record_assembly_docs(spark, sf):
    return I.records(I.parse_files(doc_files(spark, sf)))


@register("csv_parse", f"""
WITH {ROWS_CTE}
SELECT file_id, row_id, row_id AS rec_no, CAST(len(cells) AS INTEGER) AS n_cells,
       {_duck_cells_text('cells')} AS cells_text
FROM (SELECT file_id, row_id,
        list_transform(['Conversation ' || conv_id, coalesce(question, ''), coalesce(answer, '')]
                       || CASE WHEN has_client THEN ['Acme Corp ' || file_id] ELSE []::VARCHAR[] END,
                       lambda c: {_na('c')}) AS cells
      FROM truth)""")
def q_csv_parse(spark, sf):
    rows = I.csv_rows(I.parse_files(qfiles(spark, sf)))
    return rows.select("file_id", "row_id", "rec_no", F.size("cells").alias("n_cells"),
                       _cells_text(F.col("cells")).alias("cells_text"))


_DOC_ROWS = f"""
WITH {doc_text_cte()}, {parse_chain_cte('ftext')}
SELECT file_id, r.row_id, r.rec_no, CAST(len(r.cells) AS INTEGER) AS n_cells,
       {_duck_cells_text('r.cells')} AS cells_text
FROM (SELECT file_id, unnest(rows) AS r FROM parsed)"""


@register("csv_parse_docs", _DOC_ROWS)
def q_csv_parse_docs(spark, sf):
    rows = I.csv_rows(I.parse_files(doc_files(spark, sf)))
    return rows.select("file_id", "row_id", "rec_no", F.size("cells").alias("n_cells"),
                       _cells_text(F.col("cells")).alias("cells_text"))


@register("ingest_rejects", f"""
WITH {doc_text_cte()}, {parse_chain_cte('ftext')}
SELECT file_id, CAST(NULL AS BIGINT) AS rec_no, status AS reason, CAST(NULL AS VARCHAR) AS raw
FROM parsed WHERE status <> 'ok'
UNION ALL
SELECT file_id, r.rec_no, r.reason, r.raw
FROM (SELECT file_id, unnest(data) AS r FROM parsed) WHERE r.reason IS NOT NULL""")
def q_ingest_rejects(spark, sf):
    return I.rejects(I.parse_files(doc_files(spark, sf)))


@register("null_tokens", f"""
WITH {doc_text_cte()}, {parse_chain_cte('ftext')}
SELECT file_id,
       CAST(coalesce(list_sum(list_transform(rows, lambda r: len(r.cells))), 0) AS BIGINT) AS n_cells,
       CAST(coalesce(list_sum(list_transform(rows, lambda r: len(list_filter(r.cells, lambda c: c IS NULL)))), 0)
            AS BIGINT) AS n_null
FROM parsed WHERE status = 'ok'""")
def q_null_tokens(spark, sf):
    return I.null_counts(I.parse_files(doc_files(spark, sf)))


def _candidate(k: int, d: str, q: str) -> str:
    """Records and their numbers of fields under one dialect, as rows; the twin's own patterns."""
    quoted = f"{q}(?:[^{q}]|{q}{q})*"
    e = re.escape(d)
    field = rf"(?:{quoted}{q}[^{e}\n{q}]*|{quoted}\z|[^{e}{q}\n][^{e}\n]*)?"
    text = f"list_filter(regexp_extract_all(text, {sql_str(rf'({field}(?:{e}{field})*)(?:\n|\z)')}, 1), lambda r: {duck_strip('r')} <> '')"
    return f"""SELECT file_id, {k} AS k, {sql_str(d)} AS d, {sql_str(q)} AS q, text, r.rec AS rec, len(regexp_extract_all({sql_str(d)} || r.rec, {sql_str(f'{e}({field})')}, 1)) AS n
FROM (SELECT file_id, text, unnest(list_transform({text}, lambda x: {{'rec': x}})) AS r FROM ftext WHERE contains(text, {sql_str(d)}))"""


_CANDIDATES = [(d, q) for d in (",", ";", "\t", "|") for q in ('"', "'")]


@register("dialect_detect", f"""
WITH {qfiles_text_cte('qtext', ';')}, {doc_text_cte('dtext')},
ftext AS (SELECT file_id, text FROM qtext UNION ALL SELECT file_id, text FROM dtext),
records AS ({' UNION ALL '.join(_candidate(k, d, q) for k, (d, q) in enumerate(_CANDIDATES))}),
facts AS (SELECT file_id, k, any_value(d) AS d, any_value(q) AS q, any_value(text) AS text, count(*) AS records FROM records GROUP BY file_id, k),
modes AS (SELECT file_id, k, max(times) AS times FROM (SELECT file_id, k, n, count(*) AS times FROM records WHERE n > 1 GROUP BY file_id, k, n) GROUP BY file_id, k),
ranked AS (
  SELECT f.file_id, d, q, row_number() OVER (PARTITION BY f.file_id ORDER BY m.times / f.records DESC,
      1 - (length(text) - length(replace(text, d || ' ', ''))) / 2 / (length(text) - length(replace(text, d, ''))) DESC,
      len(regexp_extract_all(text, '(\\A|[\\n' || d || '])' || q)) DESC, f.k) AS place
  FROM facts AS f JOIN modes AS m ON m.file_id = f.file_id AND m.k = f.k
  WHERE q = '"' OR regexp_matches(text, '(\\A|[\\n' || d || '])' || q))
SELECT t.file_id, coalesce(d, ',') AS delimiter, coalesce(q, '"') AS quote
FROM ftext AS t LEFT JOIN (SELECT * FROM ranked WHERE place = 1) AS r ON r.file_id = t.file_id""")
def q_dialect_detect(spark, sf):
    files = qfiles(spark, sf, ";").unionByName(doc_files(spark, sf))
    found = I.decode(files).select("file_id", I.detect_dialect(F.col("text")).alias("found"))
    return found.select("file_id", "found.delimiter", "found.quote")


_PAIRS_TRUTH = f"""
SELECT file_id, id, {duck_strip('question')} AS question, {duck_strip('answer')} AS answer
FROM (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY conv_id, turn) AS BIGINT) AS id,
             {_na("coalesce(question, '')")} AS question, {_na("coalesce(answer, '')")} AS answer FROM qa)
WHERE question IS NOT NULL AND answer IS NOT NULL
  AND {duck_strip('question')} <> '' AND {duck_strip('answer')} <> ''"""


@register("qa_pairs", f"WITH {qa_source_cte()}" + _PAIRS_TRUTH)
def q_qa_pairs(spark, sf):
    return I.qa_pairs(I.parse_files(qfiles(spark, sf)))


@register("qa_pairs_semicolon", f"WITH {qa_source_cte()}" + _PAIRS_TRUTH)
def q_qa_pairs_semicolon(spark, sf):
    return I.qa_pairs(I.parse_files(qfiles(spark, sf, ";"), dialect="auto"))


def _roles_sql() -> str:
    lh = "list_transform(header, lambda x: lower(x))"
    def pos(pred):
        return f"list_position(list_transform({lh}, lambda x: {pred}), true)"
    def anyof(words):
        return "(" + " OR ".join(f"contains(x, '{w}')" for w in words) + ")"
    vals = ("list_filter(list_transform(rows, lambda r: r.cells[{i} + 1]), lambda v: v IS NOT NULL)")
    c2 = (f"list_position(list_transform(range(0, len(header)), lambda i: "
          f"contains(lower(header[i + 1]), 'name') AND NOT contains(lower(header[i + 1]), 'client') AND "
          f"len(list_filter({vals.format(i='i')}[1:{I.CLIENT_SAMPLE_ROWS}], "
          f"lambda v: length(v) < {I.CLIENT_VALUE_MAX_LEN} AND NOT starts_with(v, 'http'))) > 0), true)")
    return f"""
roles0 AS (
  SELECT file_id, header, rows,
    coalesce({pos("contains(x, 'question')")}, {pos(anyof(I.QUESTION_KEYWORDS))},
             CASE WHEN len(header) > 0 THEN 1 END) - 1 AS q_idx,
    coalesce({pos("contains(x, 'answer')")}, {pos(anyof(I.ANSWER_KEYWORDS))},
             CASE WHEN len(header) > 1 THEN 2 WHEN len(header) > 0 THEN 1 END) - 1 AS a_idx,
    coalesce({pos("contains(x, 'client') AND contains(x, 'name')")}, {c2}) - 1 AS client_idx
  FROM parsed WHERE status = 'ok'),
roles AS (
  SELECT *, CASE WHEN first IS NOT NULL THEN
      substring(replace(regexp_replace({duck_strip('first')}, {sql_str(I.FILENAME_BAD_CHARS_RE)}, '', 'g'),
                        ' ', '-'), 1, {I.CLIENT_NAME_MAX})
      ELSE '{I.DEFAULT_NAME}' END AS client_name
  FROM (SELECT *, {vals.format(i='client_idx')}[1] AS first FROM roles0))"""


ROLES_CTE = ALL_TEXT_CTE + ",\n" + parse_chain_cte("ftext") + "," + _roles_sql()


@register("column_roles", f"""
WITH {ROLES_CTE}
SELECT file_id, array_to_string(header, chr(31)) AS header_text, CAST(q_idx AS INTEGER) AS q_idx,
       CAST(a_idx AS INTEGER) AS a_idx, CAST(client_idx AS INTEGER) AS client_idx, client_name
FROM roles""")
def q_column_roles(spark, sf):
    r = I.column_roles(I.parse_files(_all_files(spark, sf)))
    return r.select("file_id", F.array_join("header", SEP).alias("header_text"), "q_idx", "a_idx",
                    "client_idx", "client_name")


@register("client_name", f"""
WITH {ROLES_CTE}
SELECT file_id, client_name,
  'sitemap_structure-' || CASE WHEN client_name IS NULL OR client_name IN ('', '{I.DEFAULT_NAME}')
      THEN 'sitemap_' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d_%H%M%S') ELSE client_name END || '.txt'
      AS output_name
FROM roles""")
def q_client_name(spark, sf):
    r = I.column_roles(I.parse_files(_all_files(spark, sf)))
    return r.select("file_id", "client_name",
                    I.output_name(F.col("client_name"), F.to_timestamp(F.lit(RUN_TS))).alias("output_name"))


@register("files_without_pairs", f"""
WITH {ROLES_CTE}
SELECT file_id FROM roles
WHERE len(list_filter(rows, lambda r:
        coalesce(r.cells[q_idx + 1], '') <> '' AND coalesce(r.cells[a_idx + 1], '') <> ''
        AND {duck_strip("r.cells[q_idx + 1]")} <> '' AND {duck_strip("r.cells[a_idx + 1]")} <> '')) = 0""")
def q_files_without_pairs(spark, sf):
    return I.files_without_pairs(I.parse_files(_all_files(spark, sf)))


@register("ingest_metrics", f"""
WITH {ALL_TEXT_CTE}, {parse_chain_cte('ftext')},
enc AS (SELECT file_id, encoding FROM ftext)
SELECT p.file_id, status, encoding, header_line,
       CAST(coalesce(len(header), 0) AS INTEGER) AS n_columns, CAST(len(rows) AS INTEGER) AS n_rows,
       CAST(len(list_filter(data, lambda x: x.reason = 'too_many_fields')) AS INTEGER) AS n_too_many_fields,
       CAST(len(list_filter(data, lambda x: x.reason = 'unclosed_quote')) AS INTEGER) AS n_unclosed,
       (status = 'ok' AND len(rows) = 0) AS empty_warning
FROM parsed p JOIN enc USING (file_id)""")
def q_ingest_metrics(spark, sf):
    return I.ingest_metrics(I.parse_files(_all_files(spark, sf)))


@register("output_name", f"""
WITH {ROLES_CTE}
SELECT file_id, 'sitemap_structure-' || CASE WHEN client_name IS NULL OR client_name IN ('', '{I.DEFAULT_NAME}')
      THEN 'sitemap_' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d_%H%M%S') ELSE client_name END || '.txt'
      AS output_name
FROM roles""")
def q_output_name(spark, sf):
    return q_client_name(spark, sf).select("file_id", "output_name")
