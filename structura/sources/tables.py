"""Parquet table access with explicit column pruning, plus file sources.

Every reader names the columns it needs so the scan's ReadSchema holds
only those (``pages.html`` is large and must never be read for URL work).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def within_limit(max_bytes: int | None):
    """The content column, null for files over ``max_bytes`` (None: no limit)."""
    content = F.col("content")
    return content if max_bytes is None else F.when(F.col("length") <= max_bytes, content)


def binary_files(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = True,
                 max_bytes: int | None = None) -> DataFrame:
    """Questionnaire files as ``file_id STRING, content BINARY, n_bytes``.

    One row per file (Spark's binaryFile source, up to 2 GB).  With
    ``max_bytes`` larger files keep their row with null content, and ingest
    rejects them as ``too_large`` (the reference's upload form takes 200 MB).
    """
    raw = (spark.read.format("binaryFile")
           .option("pathGlobFilter", glob)
           .option("recursiveFileLookup", str(recursive).lower())
           .load(path))
    return raw.select(
        F.col("path").alias("file_id"),
        within_limit(max_bytes).alias("content"),
        F.col("length").alias("n_bytes"),
    )


def xml_texts(spark: SparkSession, path: str, id_col: str = "site_id") -> DataFrame:
    """S2 (files): one sitemap document per file as ``site_id, xml``."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias(id_col), F.col("value").alias("xml")))
