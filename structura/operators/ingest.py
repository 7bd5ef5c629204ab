"""Questionnaire CSV ingest (I1-I11) and column roles, pairs, client name
(R1-R5, S5).

Design: a questionnaire file is one row (Spark's binaryFile source gives one
row per file).  Every step of the
reference's per-file parse - decode, header search, record assembly, cell
split, long-row rejection, blank-line skipping, header mangling, role and
client-name detection - is a higher-order-function expression over that
row's arrays.  Parallelism is across files; there is no shuffle, join or
window anywhere between the raw bytes and the question/answer pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import csvre
from ..functions.settle import let, settled
from ..functions.text import is_blank, na_to_null, py_strip

# --- fixed values -----------------------------------------------------------
HEADER_KEYWORDS = ["section", "question", "answer"]
QUESTION_KEYWORDS = ["q", "quest", "pitanje"]
ANSWER_KEYWORDS = ["a", "ans", "odgovor"]
FILENAME_BAD_CHARS_RE = r'[<>:"/\\|?*]'
CLIENT_NAME_MAX = 50
CLIENT_SAMPLE_ROWS = 5
CLIENT_VALUE_MAX_LEN = 100
DEFAULT_NAME = "sitemap"
DELIMITERS = [",", ";", "\t", "|"]       # candidates for dialect='auto'
QUOTES = ['"', "'"]
# ---------------------------------------------------------------------------

BOM_RE = r"\A\x{FEFF}"
CR_END_RE = r"\r\z"


# I1 --------------------------------------------------------------------------
def decode(files: DataFrame) -> DataFrame:
    """``file_id, content BINARY`` -> adds ``text`` and ``encoding``:
    UTF-8 when the bytes are valid UTF-8, else ISO-8859-1 (which accepts
    every byte); a leading byte-order mark is dropped."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = (F.when(valid, F.decode("content", "UTF-8"))
            .otherwise(F.decode("content", "ISO-8859-1")))
    enc = (F.when(F.col("content").isNull(), F.lit(None).cast("string"))
           .when(valid, F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")))
    return files.withColumn("text", F.regexp_replace(text, BOM_RE, "")).withColumn("encoding", enc)


def _count(c: Column, d: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, d, F.lit("")))


def _contains_any(c: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(c, F.lit(w))
    return cond


def _pos(arr: Column, pred) -> Column:
    """1-based position of the first element satisfying ``pred``, 0 if none."""
    return F.array_position(F.transform(arr, pred), True)


# I7 --------------------------------------------------------------------------
def detect_dialect(text: Column) -> Column:
    """Opt-in dialect sniffing: ``struct<delimiter, quote>``.

    For each delimiter and quote character the text is cut into records and
    fields under quotes, and the numbers of fields give a histogram over the
    non-blank records.  The score is the share of records with the most
    frequent number above one (the larger number on ties).  On equal scores
    the dialect wins whose delimiter is less often followed by a space (as
    it is in prose), then the one with more fields that begin with its
    quote, then the earlier candidate.  No delimiter found: comma and ``"``.
    """
    def candidate(d: str, q: str, order: int) -> Column:
        records = F.filter(F.regexp_extract_all(text, F.lit(csvre.record_re(d, q)), F.lit(1)), lambda r: ~is_blank(r))
        widths = F.transform(records, lambda r: F.size(F.regexp_extract_all(F.concat(F.lit(d), r), F.lit(csvre.cell_re(d, q)), F.lit(1))))

        def share(w: Column) -> Column:
            most = F.array_max(F.transform(F.array_distinct(F.filter(w, lambda n: n > 1)), lambda n: F.size(F.filter(w, lambda m: m == n))))
            return F.coalesce(most, F.lit(0)) / F.greatest(F.size(w), F.lit(1))

        times = _count(text, F.lit(d))
        loose = (F.length(text) - F.length(F.replace(text, F.lit(d + " "), F.lit("")))) / 2
        begun = F.regexp_count(text, F.lit(r"(?:\A|[\n" + ("\\t" if d == "\t" else d) + "])" + q))
        rank = F.struct(let(widths, share).cast("double").alias("share"), (1 - loose / F.greatest(times, F.lit(1))).cast("double").alias("tight"),
                        begun.cast("int").alias("begun"), F.lit(-order).alias("order"), F.lit(d).alias("delimiter"), F.lit(q).alias("quote"))
        there = text.contains(d) if q == QUOTES[0] else text.contains(d) & (begun > 0)
        return F.when(there, rank)

    best = F.array_max(F.array(*[candidate(d, q, len(QUOTES) * i + k) for i, d in enumerate(DELIMITERS) for k, q in enumerate(QUOTES)]))
    return let(best, lambda b: F.when(b["share"] > 0, F.struct(b["delimiter"].alias("delimiter"), b["quote"].alias("quote")))
               .otherwise(F.struct(F.lit(DELIMITERS[0]).alias("delimiter"), F.lit(QUOTES[0]).alias("quote"))))


def _re_for(delim: Column, quote: Column, make, dialect: str) -> Column:
    """The pattern of a file's dialect; one literal if all files have the same."""
    expr = F.lit(make(DELIMITERS[0], QUOTES[0]))
    if dialect == "auto":
        for d in DELIMITERS:
            for q in QUOTES:
                expr = F.when((delim == d) & (quote == q), F.lit(make(d, q))).otherwise(expr)
    return expr


def _unquote(c: Column, quote: Column, dialect: str) -> Column:
    def of(q: str) -> Column:
        pattern = csvre.quoted_cell_re(q)
        inner = F.replace(F.regexp_extract(c, pattern, 1), F.lit(q + q), F.lit(q))
        return F.when(c.rlike(pattern), F.concat(inner, F.regexp_extract(c, pattern, 2))).otherwise(c)
    return F.when(quote == QUOTES[1], of(QUOTES[1])).otherwise(of(QUOTES[0])) if dialect == "auto" else of(QUOTES[0])


def _mangle(header: Column) -> Column:
    """pandas header names: '' -> 'Unnamed: i', repeats -> 'name.k'."""
    named = F.transform(header, lambda x, i: F.when(x == "", F.concat(F.lit("Unnamed: "), i.cast("string")))
                        .otherwise(x))

    def numbered(names: Column) -> Column:  # let: a lambda would name the columns again for every column
        return F.transform(names, lambda x, i: let(
            F.size(F.filter(F.slice(names, 1, i), lambda y: y == x)),
            lambda k: F.when(k > 0, F.concat(x, F.lit("."), k.cast("string"))).otherwise(x)))
    return let(named, lambda names: F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(numbered(names)))


# I2-I10 ---------------------------------------------------------------------
def parse_files(files: DataFrame, dialect: str = "comma") -> DataFrame:
    """One row per file with every per-file result of the parse.

    ``files``: ``file_id, content BINARY`` (null content = over the limit
    that the reader was given).  ``dialect``: ``'comma'`` (the reference: comma in effect the only
    delimiter) or ``'auto'`` (I7).
    Output columns: ``file_id, encoding, delimiter, quote, status, header_kw_line,
    header_any_line, header_line, header ARRAY<STRING>, data
    ARRAY<STRUCT<rec_no, raw, cells, reason>>, rows ARRAY<STRUCT<row_id,
    rec_no, cells>>, roles STRUCT<q_idx, a_idx>``.
    """
    df = decode(files)
    text = F.col("text")
    found = detect_dialect(text) if dialect == "auto" else F.struct(F.lit(DELIMITERS[0]).alias("delimiter"), F.lit(QUOTES[0]).alias("quote"))
    df = settled(df.withColumn("dialect", found)) if dialect == "auto" else df.withColumn("dialect", found)
    df = settled(df.withColumn("delimiter", F.col("dialect.delimiter")).withColumn("quote", F.col("dialect.quote")).withColumn("lines", F.split(text, "\n", -1)).drop("dialect"))
    d = F.col("delimiter")
    kw_line = _pos(F.col("lines"), lambda l: _contains_any(F.lower(l), HEADER_KEYWORDS) & (_count(l, d) >= 2))
    any_line = _pos(F.col("lines"), lambda l: _count(l, d) >= 2)
    header_line = (F.when(kw_line > 0, kw_line - 1).when(any_line > 0, any_line - 1)
                   .otherwise(F.lit(0)))
    df = (df.withColumn("header_kw_line", F.when(kw_line > 0, kw_line - 1).cast("int"))
          .withColumn("header_any_line", F.when(any_line > 0, any_line - 1).cast("int"))
          .withColumn("header_line", header_line.cast("int")))
    n = F.size("lines")
    h = F.col("header_line")
    after = F.slice(F.col("lines"), h + 2, n)
    no_data = (h > 0) & ~F.exists(after, lambda l: ~is_blank(l))
    body = F.array_join(F.slice(F.col("lines"), h + 1, n), "\n")
    rec_re = _re_for(d, F.col("quote"), csvre.record_re, dialect)
    cell_re = _re_for(d, F.col("quote"), csvre.cell_re, dialect)
    records = F.transform(F.regexp_extract_all(body, rec_re, 1),
                          lambda r: F.regexp_replace(r, CR_END_RE, ""))
    with_cells = F.transform(records, lambda r: F.struct(
        r.alias("raw"),
        F.transform(F.regexp_extract_all(F.concat(d, r), cell_re, 1), lambda c: _unquote(c, F.col("quote"), dialect)).alias("cells")))
    non_blank = F.filter(with_cells, lambda x: ~((F.size(x["cells"]) == 1) & is_blank(x["cells"][0])))
    df = settled(df.withColumn("nb", non_blank))
    header = _mangle(F.coalesce(F.get(F.col("nb"), 0)["cells"], F.array().cast("array<string>")))
    df = settled(df.withColumn("header", header))
    unclosed = _re_for(d, F.col("quote"), csvre.unclosed_re, dialect)
    data = F.transform(F.slice(F.col("nb"), 2, n), lambda x, i: F.struct(
        i.cast("bigint").alias("rec_no"), x["raw"].alias("raw"),
        F.transform(x["cells"], na_to_null).alias("cells"),
        F.when(F.regexp_like(x["raw"], unclosed), F.lit("unclosed_quote"))
         .when(F.size(x["cells"]) > F.size("header"), F.lit("too_many_fields")).alias("reason")))
    status = (F.when(F.col("content").isNull(), F.lit("too_large"))
              .when(is_blank(text), F.lit("empty"))
              .when(no_data, F.lit("no_data_after_header"))
              .when(F.size("nb") == 0, F.lit("no_columns"))
              .otherwise(F.lit("ok")))
    df = df.withColumn("status", status)
    ok = F.col("status") == "ok"
    df = settled(df.withColumn("data", F.when(ok, data).otherwise(F.array())).drop("nb", "lines", "text"))
    kept = F.filter(F.col("data"), lambda x: x["reason"].isNull())
    rows = F.transform(kept, lambda x, i: F.struct(i.cast("bigint").alias("row_id"), x["rec_no"].alias("rec_no"),
                                                   x["cells"].alias("cells")))
    df = settled(df.select("file_id", "encoding", "delimiter", "quote", "status", "header_kw_line", "header_any_line",
                            "header_line", F.when(ok, F.col("header")).alias("header"), "data", rows.alias("rows")))
    return settled(df.withColumn("roles", _roles(F.col("header"))))


def _explode(parsed: DataFrame, arr: Column, name: str = "r") -> DataFrame:
    """``file_id`` x elements of ``arr``.

    ``explode_outer`` plus a null filter on the generated column: an inner
    ``explode`` makes Catalyst infer ``size(arr) > 0`` and push it below the
    projections, where it would re-evaluate the whole per-file parse.
    """
    return (parsed.select("file_id", F.explode_outer(arr).alias(name))
            .filter(F.col(name).isNotNull()))


def _one_if(cond: Column, value: Column) -> Column:
    """A 0- or 1-element array: per-file conditions stay inside the row."""
    return F.when(cond, F.array(value))


def records(parsed: DataFrame) -> DataFrame:
    """Assembled (multi-line) data records in file order."""
    return _explode(parsed, F.col("data")).select("file_id", "r.rec_no", "r.raw")


def csv_rows(parsed: DataFrame) -> DataFrame:
    """``file_id, row_id, rec_no, cells`` for kept rows; NA tokens
    are null; a short row is simply a shorter array (``get`` gives null)."""
    return _explode(parsed, F.col("rows")).select("file_id", "r.row_id", "r.rec_no", "r.cells")


def rejects(parsed: DataFrame) -> DataFrame:
    """``file_id, rec_no, reason, raw`` - whole files that cannot
    be read (rec_no null) and records dropped from readable files."""
    file_level = _one_if(F.col("status") != "ok", F.struct(
        F.lit(None).cast("bigint").alias("rec_no"), F.col("status").alias("reason"),
        F.lit(None).cast("string").alias("raw")))
    rec_level = F.transform(F.filter("data", lambda x: x["reason"].isNotNull()),
                            lambda x: F.struct(x["rec_no"].alias("rec_no"), x["reason"].alias("reason"),
                                               x["raw"].alias("raw")))
    empty = F.array().cast("array<struct<rec_no:bigint,reason:string,raw:string>>")
    both = F.concat(F.coalesce(file_level, empty), F.coalesce(rec_level, empty))
    return _explode(parsed, both).select("file_id", "r.rec_no", "r.reason", "r.raw")


# R1 / R4 / R5 --------------------------------------------------------------
def _roles(header: Column) -> Column:
    """Indexes of the question and the answer column."""
    lh = F.transform(header, F.lower)
    n = F.size(header)
    q1 = _pos(lh, lambda x: F.contains(x, F.lit("question")))
    a1 = _pos(lh, lambda x: F.contains(x, F.lit("answer")))
    q2 = _pos(lh, lambda x: _contains_any(x, QUESTION_KEYWORDS))
    a2 = _pos(lh, lambda x: _contains_any(x, ANSWER_KEYWORDS))
    q_idx = F.when(q1 > 0, q1 - 1).when(q2 > 0, q2 - 1).when(n > 0, F.lit(0))
    a_idx = F.when(a1 > 0, a1 - 1).when(a2 > 0, a2 - 1).when(n > 1, F.lit(1)).when(n > 0, F.lit(0))
    return F.struct(q_idx.cast("int").alias("q_idx"), a_idx.cast("int").alias("a_idx"))


def _client(header: Column, rows: Column) -> Column:
    """Index of the client-name column and the name."""
    lh = F.transform(header, F.lower)

    def values(i):
        return F.filter(F.transform(rows, lambda r: F.get(r["cells"], i)), lambda v: v.isNotNull())

    # let: a lambda would work the index out again for every row, and the header's lower case for every column
    c1 = _pos(lh, lambda x: F.contains(x, F.lit("client")) & F.contains(x, F.lit("name")))
    c2 = F.array_position(F.transform(
        lh, lambda x, i: F.contains(x, F.lit("name")) & ~F.contains(x, F.lit("client"))
        & F.exists(F.slice(values(i), 1, CLIENT_SAMPLE_ROWS),
                   lambda v: (F.length(v) < CLIENT_VALUE_MAX_LEN) & ~v.startswith(F.lit("http")))), True)
    c_idx = let(c1, lambda one: F.when(one > 0, one - 1).otherwise(let(c2, lambda two: F.when(two > 0, two - 1)))).cast("int")

    def named(first: Column) -> Column:
        cleaned = F.substring(F.replace(F.regexp_replace(py_strip(first), FILENAME_BAD_CHARS_RE, ""),
                                        F.lit(" "), F.lit("-")), 1, CLIENT_NAME_MAX)
        return F.when(first.isNotNull(), cleaned).otherwise(F.lit(DEFAULT_NAME))

    return let(c_idx, lambda i: F.struct(i.alias("client_idx"), let(F.get(values(i), 0), named).alias("client_name")))


def client_name(parsed: DataFrame) -> Column:
    """R5 in-row: the client's name, null for unreadable files."""
    return F.when(F.col("status") == "ok", _client(F.col("header"), F.col("rows"))["client_name"])


def column_roles(parsed: DataFrame) -> DataFrame:
    """``file_id, header, q_idx, a_idx, client_idx, client_name``
    for every readable file."""
    r = F.col("roles")
    one = _one_if(F.col("status") == "ok", let(_client(F.col("header"), F.col("rows")), lambda c: F.struct(
        F.col("header").alias("header"), r["q_idx"].alias("q_idx"), r["a_idx"].alias("a_idx"),
        c["client_idx"].alias("client_idx"), c["client_name"].alias("client_name"))))
    return _explode(parsed, one).select("file_id", "r.header", "r.q_idx", "r.a_idx", "r.client_idx",
                                        "r.client_name")


def output_name(client_name: Column, run_ts: Column) -> Column:
    """The tree download's file name."""
    suffix = (F.when(client_name.isNull() | client_name.isin("", DEFAULT_NAME),
                     F.concat(F.lit("sitemap_"), F.date_format(run_ts, "yyyyMMdd_HHmmss")))
              .otherwise(client_name))
    return F.concat(F.lit("sitemap_structure-"), suffix, F.lit(".txt"))


def _pair(row: Column, q_idx: Column, a_idx: Column) -> Column:
    q = F.coalesce(F.get(row["cells"], q_idx), F.lit(""))
    a = F.coalesce(F.get(row["cells"], a_idx), F.lit(""))
    keep = (q != "") & (a != "") & ~is_blank(q) & ~is_blank(a)
    return F.struct((row["row_id"] + 1).alias("id"), py_strip(q).alias("question"),
                    py_strip(a).alias("answer"), keep.alias("keep"))


def pair_array(parsed: DataFrame) -> Column:
    """R2 in-row: the file's pairs as ``ARRAY<STRUCT<id, question, answer, keep>>``
    in row order (null for unreadable files)."""
    r = F.col("roles")
    return F.filter(F.transform(F.col("rows"), lambda row: _pair(row, r["q_idx"], r["a_idx"])),
                    lambda p: p["keep"])


def qa_pairs(parsed: DataFrame) -> DataFrame:
    """R2: ``file_id, id, question, answer`` (id = data row index + 1)."""
    return _explode(parsed, pair_array(parsed), "p").select("file_id", "p.id", "p.question", "p.answer")


def ingest_metrics(parsed: DataFrame) -> DataFrame:
    """Per file status, encoding, header line, columns, rows, rejects."""
    return parsed.select(
        "file_id", "status", "encoding", "header_line",
        F.coalesce(F.size("header"), F.lit(0)).alias("n_columns"),
        F.size("rows").alias("n_rows"),
        F.size(F.filter("data", lambda x: x["reason"] == "too_many_fields")).alias("n_too_many_fields"),
        F.size(F.filter("data", lambda x: x["reason"] == "unclosed_quote")).alias("n_unclosed"),
        ((F.col("status") == "ok") & (F.size("rows") == 0)).alias("empty_warning"))


def files_without_pairs(parsed: DataFrame) -> DataFrame:
    """Readable files that yield no question/answer pair (in-row test,
    so no anti join is needed)."""
    r = F.col("roles")
    has_pair = F.exists(F.col("rows"), lambda row: _pair(row, r["q_idx"], r["a_idx"])["keep"])
    one = _one_if((F.col("status") == "ok") & ~has_pair, F.col("file_id"))
    return _explode(parsed, one, "f").select("file_id")


def null_counts(parsed: DataFrame) -> DataFrame:
    """I9 report: cells and NA-token (null) cells per readable file."""
    n_cells = F.aggregate("rows", F.lit(0).cast("bigint"), lambda acc, r: acc + F.size(r["cells"]))
    n_null = F.aggregate("rows", F.lit(0).cast("bigint"),
                         lambda acc, r: acc + F.size(F.filter(r["cells"], lambda c: c.isNull())))
    one = _one_if(F.col("status") == "ok", F.struct(n_cells.alias("n_cells"), n_null.alias("n_null")))
    return _explode(parsed, one).select("file_id", "r.n_cells", "r.n_null")
