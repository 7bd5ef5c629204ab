"""I1-I9 and R1-R3 for large files: one questionnaire read by many tasks.

``ingest.parse_files`` holds a file in a row (2 GB at most).  Here a file is
lines in many splits.  Whether a line begins inside quotes depends on all
lines before it, so every line first gives a function: does the next line
begin inside quotes if this one begins outside, and if it begins inside?
There are four such functions (two constants, keep, swap), and a running
composition of them needs only the last constant and a count of swaps.
Each block of a file composes its own lines, the blocks of a file are
composed in a table of one row per block, and every line then knows where
its record begins.  Records are put together across block borders, and
cells, rejects and pairs follow per record with the same expressions as for
whole files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import csvre
from ..functions.joins import join_group_facts
from ..functions.order import ranked
from ..functions.scratch import materialize
from ..functions.settle import settled
from ..functions.text import is_blank, na_to_null
from ..sources.split import placed, split_records
from . import ingest as I


@dataclass(frozen=True)
class SplitParse:
    """``files``: ``file_id, encoding, status, header_line, header, q_idx, a_idx, n_records``; ``records``: ``file_id, rec_no, raw, cells, reason, row_id`` of all data records."""

    files: DataFrame
    records: DataFrame


def _ends_inside(line: Column, delimiter: str, quote: str) -> Column:
    """Whether the record that is open at the end of ``line`` is inside quotes."""
    found = F.filter(F.regexp_extract_all(line, F.lit(csvre.record_re(delimiter, quote)), F.lit(1)), lambda r: r != "")
    return F.when(line.contains(quote), F.coalesce(F.element_at(F.slice(found, F.greatest(F.size(found), F.lit(1)), F.lit(1)), 1).rlike(csvre.unclosed_re(delimiter, quote)),
                                                   F.lit(False))).otherwise(F.lit(False))


def _decoded_lines(spark: SparkSession, path: str, glob: str | None, file_id_re: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines ``file_id, start, at, place, line``, the blocks, and ``file_id, encoding`` of every file."""
    rows, blocks = split_records(spark, path, "\n", glob, file_id_re)
    counts = rows.groupBy("file_id").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("size"))
    encodings = materialize(counts.select("file_id", F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), "n", "size"), "split-encodings")
    # the text source names no empty last line: the file's size tells whether the text ends with a line end
    ends = blocks.groupBy("file_id").agg(F.max("bytes").alias("bytes"), F.max(F.struct("start", (F.col("first") + F.col("n")).alias("at"))).alias("end"))
    blank = ends.join(encodings, "file_id").filter("bytes = size + n").select("file_id", "end.start", "end.at", F.col("n").alias("place"), F.lit("").alias("line"))
    encodings = encodings.drop("size")
    lines = join_group_facts(placed(rows, blocks).drop("total"), encodings, ["file_id"], "n")
    text = F.when(F.col("encoding") == "UTF-8", F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    line = F.when(F.col("place") == 0, F.regexp_replace(text, I.BOM_RE, "")).otherwise(text)
    return lines.select("file_id", "start", "at", "place", line.alias("line")).unionByName(blank), blocks, encodings.select("file_id", "encoding")


def _records(lines: DataFrame, blocks: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """``file_id, rec, text``: the lines (``file_id, start, at, place, line, header_line``) from the header on as records; ``rec`` is the first line's place."""
    body = F.col("place") >= F.col("header_line")
    outside, inside = _ends_inside(F.col("line"), delimiter, quote), _ends_inside(F.concat(F.lit(quote), F.col("line")), delimiter, quote)
    steps = lines.withColumn("a", F.when(body, outside).otherwise(F.lit(False))).withColumn("b", F.when(body, inside).otherwise(F.lit(False)))
    steps = steps.withColumn("fixed", F.col("a") == F.col("b")).withColumn("swap", (F.col("a") & ~F.col("b")).cast("int"))
    so_far = Window.partitionBy("file_id", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("swaps", F.sum("swap").over(so_far))
    steps = steps.withColumn("held", F.last(F.when(F.col("fixed"), F.struct(F.col("a").cast("int").alias("value"), F.col("swaps").alias("swaps"))), ignorenulls=True).over(so_far))
    # after this line: a value, or (no constant yet) the block's begin with or without a swap
    known = F.col("held").isNotNull()
    steps = materialize(steps.select("file_id", "start", "at", "place", "line", "header_line", known.alias("known"),
                                     F.when(known, (F.col("held.value") + F.col("swaps") - F.col("held.swaps")) % 2).otherwise(F.col("swaps") % 2).alias("odd")), "split-steps")
    ends = steps.groupBy("file_id", "start").agg(F.max_by(F.struct("known", "odd"), "at").alias("end"))
    whole = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    ends = ends.withColumn("swaps", F.sum(F.when(F.col("end.known"), 0).otherwise(F.col("end.odd"))).over(whole))
    upto = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("run", F.sum(F.when(F.col("end.known"), 0).otherwise(F.col("end.odd"))).over(upto))
    ends = ends.withColumn("held", F.last(F.when(F.col("end.known"), F.struct(F.col("end.odd").alias("value"), F.col("run").alias("run"))), ignorenulls=True).over(whole))
    began = (F.coalesce(F.col("held.value"), F.lit(0)) + F.coalesce("swaps", F.lit(0)) - F.coalesce(F.col("held.run"), F.lit(0))) % 2
    begins = ends.select("file_id", "start", began.alias("began")).join(blocks.select("file_id", "start", "n"), ["file_id", "start"])
    j = join_group_facts(steps, materialize(begins, "split-begins"), ["file_id", "start"], "n")
    after = F.when(F.col("known"), F.col("odd")).otherwise((F.col("odd") + F.col("began")) % 2)
    in_block = Window.partitionBy("file_id", "start").orderBy("at")
    opens = (F.coalesce(F.lag(after).over(in_block), F.col("began")) == 0) & (F.col("place") >= F.col("header_line"))
    j = j.withColumn("first", F.last(F.when(opens, F.col("place")), ignorenulls=True).over(so_far))
    j = materialize(j.filter(F.col("place") >= F.col("header_line")).select("file_id", "start", "place", "line", "first"), "split-lines")
    # lines at the begin of a block may belong to a record that an earlier block opened
    last = j.groupBy("file_id", "start").agg(F.max("first").alias("last"), F.count("*").alias("n"))
    carried = materialize(last.withColumn("carried", F.last("last", ignorenulls=True).over(whole)).drop("last"), "split-carried")
    j = join_group_facts(j, carried, ["file_id", "start"], "n").withColumn("rec", F.coalesce("first", "carried"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return j.groupBy("file_id", "rec").agg(text.alias("text"))


def parse_split(spark: SparkSession, path: str, glob: str | None = None, file_id_re: str | None = None, delimiter: str = ",", quote: str = '"') -> SplitParse:
    """All questionnaire files under ``path``, as ``ingest.parse_files`` reads them, without holding a file in a row.

    One record must fit a value (2 GB).  ``file_id``: the path, or the
    first group of ``file_id_re`` in it.  Empty files have the status
    ``empty`` and no records.
    """
    lines, blocks, encodings = _decoded_lines(spark, path, glob, file_id_re)
    lines = materialize(lines, "split-decoded")
    commas = F.length("line") - F.length(F.replace(F.col("line"), F.lit(delimiter), F.lit("")))
    keyword = I._contains_any(F.lower("line"), I.HEADER_KEYWORDS)
    filled = F.when(~is_blank(F.col("line")), F.col("place"))
    facts = lines.groupBy("file_id").agg(F.min(F.when(keyword & (commas >= 2), F.col("place"))).alias("kw"), F.min(F.when(commas >= 2, F.col("place"))).alias("any"),
                                         F.max(filled).alias("last"), F.count("*").alias("n"))
    facts = materialize(facts.withColumn("header_line", F.coalesce("kw", "any", F.lit(0)).cast("int")), "split-facts")
    located = join_group_facts(lines, facts.select("file_id", "header_line", "n"), ["file_id"], "n").drop("n")
    texts = _records(located, blocks, delimiter, quote)
    found = F.transform(F.regexp_extract_all("text", F.lit(csvre.record_re(delimiter, quote)), F.lit(1)), lambda r: F.regexp_replace(r, I.CR_END_RE, ""))
    split = settled(texts.select("file_id", "rec", F.posexplode(found).alias("sub", "raw")))
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(delimiter), F.col("raw")), F.lit(csvre.cell_re(delimiter, quote)), F.lit(1)),
                        lambda c: I._unquote(c, F.lit(quote), "auto" if quote != I.QUOTES[0] else "comma"))
    split = settled(split.withColumn("cells", cells)).filter(~((F.size("cells") == 1) & is_blank(F.get("cells", F.lit(0)))))
    numbered = materialize(ranked(split, ["file_id"], ["rec", "sub"], "nth"), "split-records")
    header = numbered.filter("nth = 0").select("file_id", I._mangle(F.col("cells")).alias("header"))
    counts = numbered.groupBy("file_id").agg(F.count("*").alias("n_records"))
    files = encodings.join(facts, "file_id").join(header, "file_id", "left").join(counts, "file_id", "left")
    no_data = (F.col("header_line") > 0) & (F.col("last") <= F.col("header_line"))
    status = (F.when(F.col("last").isNull(), F.lit("empty")).when(no_data, F.lit("no_data_after_header")).when(F.col("header").isNull(), F.lit("no_columns")).otherwise(F.lit("ok")))
    files = files.withColumn("status", status).withColumn("roles", F.when(F.col("status") == "ok", I._roles(F.col("header"))))
    files = files.select("file_id", "encoding", "status", "header_line", F.when(F.col("status") == "ok", F.col("header")).alias("header"), "roles.q_idx", "roles.a_idx",
                         F.coalesce("n_records", F.lit(0).cast("bigint")).alias("n_records"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (listed.option("pathGlobFilter", glob) if glob else listed).load(path).filter("length = 0").select(
        (F.regexp_extract("path", file_id_re, 1) if file_id_re else F.col("path")).alias("file_id"))
    blank = listed.select("file_id", F.lit("UTF-8").alias("encoding"), F.lit("empty").alias("status"), F.lit(0).alias("header_line"), F.lit(None).cast("array<string>").alias("header"),
                          F.lit(None).cast("int").alias("q_idx"), F.lit(None).cast("int").alias("a_idx"), F.lit(0).cast("bigint").alias("n_records"))
    files = materialize(files.unionByName(blank), "split-files")
    width = files.filter("status = 'ok'").select("file_id", F.size("header").alias("width"), "n_records")
    data = join_group_facts(numbered.filter("nth > 0"), width, ["file_id"], "n_records")
    reason = F.when(F.col("raw").rlike(csvre.unclosed_re(delimiter, quote)), F.lit("unclosed_quote")).when(F.size("cells") > F.col("width"), F.lit("too_many_fields"))
    data = data.select("file_id", (F.col("nth") - 1).alias("rec_no"), "raw", F.transform("cells", na_to_null).alias("cells"), reason.alias("reason"))
    data = materialize(data, "split-data")
    kept = ranked(data.filter("reason is null"), ["file_id"], ["rec_no"], "row_id")
    return SplitParse(files, kept.unionByName(data.filter("reason is not null").withColumn("row_id", F.lit(None).cast("bigint"))))


def split_rows(parsed: SplitParse) -> DataFrame:
    """``file_id, row_id, rec_no, cells`` of the kept rows."""
    return parsed.records.filter("reason is null").select("file_id", "row_id", "rec_no", "cells")


def split_rejects(parsed: SplitParse) -> DataFrame:
    """``file_id, rec_no, reason, raw``."""
    whole = parsed.files.filter("status <> 'ok'").select("file_id", F.lit(None).cast("bigint").alias("rec_no"), F.col("status").alias("reason"), F.lit(None).cast("string").alias("raw"))
    return whole.unionByName(parsed.records.filter("reason is not null").select("file_id", "rec_no", "reason", "raw"))


def split_pairs(parsed: SplitParse) -> DataFrame:
    """R2: ``file_id, id, question, answer``."""
    roles = parsed.files.filter("status = 'ok'").select("file_id", "q_idx", "a_idx", "n_records")
    rows = join_group_facts(split_rows(parsed), roles, ["file_id"], "n_records")
    pair = I._pair(F.struct("row_id", "cells"), F.col("q_idx"), F.col("a_idx"))
    return settled(rows.select("file_id", pair.alias("p"))).filter("p.keep").select("file_id", "p.id", "p.question", "p.answer")
