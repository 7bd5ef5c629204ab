"""S2 for large files: one sitemap read by many tasks.

The file is cut behind every ``</url>``.  Each piece, set between the root's
start and end tag, is a small document of its own; if every piece of a file
is well formed and holds exactly one ``url`` (the last none), the file is
well formed and its records are those of the pieces, in order.  Files where
a piece is not like that (other prefixes, nested or empty ``url`` elements,
namespaces declared below the root, a DOCTYPE, damage) are put together
again and read as a whole, as ``sitemap_parse`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import join_group_facts
from ..functions.scratch import materialize
from ..sources.split import placed, split_records
from .sitemap import URL_FIELDS, clean, parsed_entries, sitemap_parse
from .xmlfold import ROOT_RE, URL_RE, tags_and_text

SEPARATOR = "</url>"


def sitemap_parse_files(spark: SparkSession, path: str, require_namespace: bool = True, glob: str | None = None, file_id_re: str | None = None) -> DataFrame:
    """Records of all sitemap files under ``path``: ``site_id, pos, url, lastmod, changefreq, priority, method``.

    Equal to ``sitemap_parse`` of each whole text.  ``site_id`` is the path
    or the first group of ``file_id_re`` in it.  Empty files give no records.
    """
    rows, blocks = split_records(spark, path, SEPARATOR, glob, file_id_re)
    pieces = materialize(placed(rows, blocks).select("file_id", "place", "total", "value"), "sitemap-pieces")
    first = F.regexp_extract(tags_and_text(F.col("value")), ROOT_RE, 1)
    heads = pieces.filter("place = 0").select("file_id", F.when(~F.col("value").contains("<!DOCTYPE"), first).alias("root"), F.col("total").alias("n"))
    heads = materialize(heads.withColumn("close", F.concat(F.lit("</"), F.regexp_extract("root", r"\A<([^\s/>]++)", 1), F.lit(">"))), "sitemap-heads")
    k, last = F.col("place"), F.col("place") == F.col("total") - 1
    text = F.concat(F.when(k > 0, F.col("root")).otherwise(F.lit("")), F.col("value"), F.when(last, F.lit("")).otherwise(F.concat(F.lit(SEPARATOR), "close")))
    docs = join_group_facts(pieces, heads, ["file_id"], "n").select(
        "file_id", "place", "total", ((F.regexp_count("value", F.lit(URL_RE)) == F.when(last, 0).otherwise(1)) & ((k == 0) | ~F.col("value").contains("xmlns"))
                                      & (F.coalesce("root", F.lit("")) != "")).alias("plain_piece"), text.alias("xml"))
    read = materialize(parsed_entries(docs, require_namespace).drop("xml"), "sitemap-read")
    whole = materialize(read.groupBy("file_id").agg(F.bool_and(F.col("plain_piece") & F.col("entries").isNotNull() & (F.col("total") > 1)).alias("apart"), F.count("*").alias("n")), "sitemap-files")
    good = join_group_facts(read, whole.filter("apart"), ["file_id"], "n").select("file_id", "place", F.explode_outer("entries").alias("e")).filter("e is not null")
    good = good.select(F.col("file_id").alias("site_id"), F.col("place").alias("pos"), clean(F.col("e.loc")).alias("url"),
                       *(clean(F.col(f"e.{f}")).alias(f) for f in URL_FIELDS[1:]), F.lit("xml").alias("method"))
    # the text source names no empty last record: the file's size tells whether the text ends with the separator
    size = blocks.groupBy("file_id").agg(F.max("bytes").alias("bytes"))
    bad = pieces.join(whole.filter("not apart").select("file_id"), "file_id").groupBy("file_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), SEPARATOR).alias("xml"))
    ended = F.col("bytes") == F.octet_length("xml") + len(SEPARATOR)
    texts = bad.join(size, "file_id").select(F.col("file_id").alias("site_id"), F.when(ended, F.concat("xml", F.lit(SEPARATOR))).otherwise(F.col("xml")).alias("xml"))
    return good.unionByName(sitemap_parse(texts, ("site_id",), require_namespace))
