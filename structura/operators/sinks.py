"""Sinks: the tree download (S3) and sitemap files.

The reference offers the printed tree as one text file per questionnaire,
named by S5.  Here every site's lines are written as ordered text under a
folder per site and output name; nothing passes through the driver and no
task holds more than one partition of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import BROADCAST_RUNS
from ..functions.scratch import materialize
from .sitemap import SITEMAP_HEAD, sitemap_entry


def write_tree_files(lines: DataFrame, names: DataFrame, path: str, partitions: int | None = None) -> None:
    """S3: ``lines`` (``site_id, line_no, line``) to ``path/site_id=<id>/output_name=<name>/part-*``.

    ``names``: ``site_id, output_name`` (see ``ingest.output_name``); two
    sites may share a name and stay apart.  Rows are range-partitioned on
    ``(site_id, line_no)``, so a very large site spreads over several part
    files, each a consecutive run of lines; the part files in name order
    give the site's text.
    """
    j = lines.select("site_id", "line_no", "line").join(names.select("site_id", "output_name"), "site_id")
    n = partitions or lines.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (j.repartitionByRange(int(n), "site_id", "line_no")
     .sortWithinPartitions("site_id", "output_name", "line_no")
     .select("site_id", "output_name", "line")
     .write.mode("overwrite").partitionBy("site_id", "output_name").text(path))


def read_tree_files(spark: SparkSession, path: str) -> DataFrame:
    """The written lines in file order: ``site_id, output_name, line_no, line``.

    The text source reads a file in order; a line's place in its file plus
    the lines of the site's earlier files is its number.  Ids and names come
    back as they were written (``007`` stays ``007``).
    """
    return _ordered_lines(spark, path, ["site_id", "output_name"])


def _ordered_lines(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Lines of text files in folders by ``keys``, numbered from 1 in the order of parts and places: ``keys, line_no, line``."""
    text = spark.read.schema(", ".join(["value string", *(f"{k} string" for k in keys)])).text(path)
    rows = text.select(*(F.coalesce(k, F.lit("")).alias(k) for k in keys), F.col("value").alias("line"), F.input_file_name().alias("file"),
                       F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(rows, "lines-read")
    block = [*keys, "file", "start"]
    runs = rows.groupBy(*block).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    part = F.regexp_extract("file", r"/part-([0-9]+)[^/]*\z", 1).try_cast("bigint")  # names stop sorting at 100,000 parts
    before = Window.partitionBy(*keys).orderBy(part, "file", "start").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(*block, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "lines-runs")
    few = runs.count() <= BROADCAST_RUNS  # one per block of a file: else every line would be moved with its file's name, a file to a task
    return rows.join(F.broadcast(runs) if few else runs, block).select(*keys, (F.col("at") + F.col("shift") + 1).alias("line_no"), "line")


def write_sitemap_files(urls: DataFrame, path: str, partitions: int | None = None) -> None:
    """S4 as files: one sitemap per site under ``path/site_id=<id>/part-*``, in ``pos`` order.

    ``sitemap_write`` holds a site's document in one value; here header,
    entries and footer are ordered rows, range-partitioned, so a site of
    any size spreads over part files that follow each other in name order.
    """
    rows = urls.select("site_id", F.lit(1).alias("kind"), "pos", F.regexp_replace(sitemap_entry(), r"\n\z", "").alias("text"))
    frame = urls.select("site_id").distinct().select("site_id", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(SITEMAP_HEAD).alias("text")), F.struct(F.lit(2).alias("kind"), F.lit("</urlset>").alias("text")))).alias("f"))
    every = rows.unionByName(frame.select("site_id", "f.kind", F.lit(0).cast("bigint").alias("pos"), "f.text"))
    order = ["site_id", "kind", "pos", "text"]
    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (every.repartitionByRange(n, *order).sortWithinPartitions(*order).select("site_id", "text")
     .write.mode("overwrite").partitionBy("site_id").text(path))


def read_sitemap_lines(spark: SparkSession, path: str) -> DataFrame:
    """The written sitemaps: ``site_id, line_no, line``; a site's lines joined by line ends are its document."""
    return _ordered_lines(spark, path, ["site_id"])


def site_output_names(urls: DataFrame, run_ts: str) -> DataFrame:
    """S5 for URL tables without a questionnaire: the site id is the name."""
    from .ingest import output_name
    return (urls.select("site_id").distinct()
            .select("site_id", output_name(F.col("site_id"), F.to_timestamp(F.lit(run_ts))).alias("output_name")))
