"""Text files read by many tasks each.

Spark's text source cuts a file into splits at any byte and hands out
records that end with a given separator, whole, each to one task.  Here
every record also gets its place in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialize

BLOCK = ["file_id", "start"]


def split_records(spark: SparkSession, path: str, separator: str, glob: str | None = None, file_id_re: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``file_id, start, at, value`` of every record, and ``file_id, start, first, n, before, total, bytes`` of every block.

    A block is the part of a file that one split has; within it ``at`` rises
    by one from ``first``, and ``before`` records of the file come before
    it, of ``total``.  ``file_id``: the path, or the first group of
    ``file_id_re`` in it.  The blocks are few: one row per file and split.
    """
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    file_id = F.input_file_name()
    rows = reader.text(path).select(
        (F.regexp_extract(file_id, file_id_re, 1) if file_id_re else file_id).alias("file_id"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("at"), "value")
    rows = materialize(rows, "split-records")
    blocks = rows.groupBy(*BLOCK).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    earlier = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("file_id")))
    return rows.drop("bytes"), materialize(blocks, "split-blocks")


def placed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with ``place``, the 0-based place in the file, and ``total``."""
    from ..functions.joins import join_group_facts
    j = join_group_facts(rows, blocks.select(*BLOCK, "first", "n", "before", "total"), BLOCK, "n")
    return j.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("first", "n", "before")
