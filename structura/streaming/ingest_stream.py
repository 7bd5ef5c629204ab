"""G1: incremental ingest of a landing folder of questionnaire files.

``readStream.format('binaryFile')`` picks up new files; each micro-batch
runs the same batch functions (parse -> pairs), which use per-file arrays
and so need no stream-unsupported window.  ``foreachBatch`` writes the
pairs to ``out/pairs`` and the rejects to ``out/rejects``, each batch to a
partition of its own that is overwritten: a batch that is run again after
a failure replaces its rows and repeats none.  The checkpoint records
which files were done.

A file id may come again, as a new upload at another path.  Its latest
version counts: the one modified last, the later path on ties, then the
later batch.  Every batch writes the versions that it has read to
``out/versions``, one small row per file, and the readers take the pairs
and rejects of each file's latest version only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import parse_files, qa_pairs, rejects
from ..sources.tables import within_limit

STREAM_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def start_ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str,
                        glob: str = "*", available_now: bool = True, file_id_re: str | None = None,
                        max_bytes: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``file_id_re``: optional regex whose group 1, taken from the path, is
    the file id (default: the whole path).
    """
    src = (spark.readStream.format("binaryFile").schema(STREAM_SCHEMA)
           .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
           .load(landing))
    fid = F.regexp_extract("path", file_id_re, 1) if file_id_re else F.col("path")
    files = src.select(fid.alias("file_id"), within_limit(max_bytes).alias("content"), F.col("modificationTime").alias("modified"), "path")

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(df, batch_id, out)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def write_batch(files: DataFrame, batch_id: int, out: str) -> None:
    """Versions, pairs and rejects of one batch, each in its own overwritten folder.

    ``files``: ``file_id, content`` and, if known, ``modified, path``; of
    several versions of a file in one batch the latest is read.
    """
    for name, kind in (("modified", "timestamp"), ("path", "string")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    version = F.struct("modified", "path")
    latest = files.groupBy("file_id").agg(F.max(version).alias("v")).select("file_id", "v.modified", "v.path")
    same = F.col("f.file_id").eqNullSafe(F.col("l.file_id")) & F.col("f.modified").eqNullSafe(F.col("l.modified")) & F.col("f.path").eqNullSafe(F.col("l.path"))
    parsed = parse_files(files.alias("f").join(latest.alias("l"), same, "left_semi").select("file_id", "content"))
    # the versions come last: until they are there, readers see the version before
    qa_pairs(parsed).write.mode("overwrite").parquet(f"{out}/pairs/batch_id={batch_id}")
    rejects(parsed).write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
    latest.write.mode("overwrite").parquet(f"{out}/versions/batch_id={batch_id}")


def read_versions(spark: SparkSession, out: str) -> DataFrame:
    """``file_id, modified, path, batch_id``: the latest version of every file."""
    rows = _read(spark, f"{out}/versions", "file_id string, modified timestamp, path string, batch_id int")
    return rows.groupBy("file_id").agg(F.max(F.struct("modified", "path", "batch_id")).alias("v")).select("file_id", "v.modified", "v.path", "v.batch_id")


def read_pairs(spark: SparkSession, out: str) -> DataFrame:
    """The pairs of every file's latest version (none when no batch was written yet)."""
    return _latest(spark, out, _read(spark, f"{out}/pairs", "file_id string, id bigint, question string, answer string, batch_id int"))


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    return _latest(spark, out, _read(spark, f"{out}/rejects", "file_id string, rec_no bigint, reason string, raw string, batch_id int"))


def _latest(spark: SparkSession, out: str, rows: DataFrame) -> DataFrame:
    return rows.join(read_versions(spark, out).select("file_id", "batch_id"), ["file_id", "batch_id"], "left_semi")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
