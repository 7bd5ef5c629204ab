"""Spark session helpers.

Library functions take the caller's session and never change its cluster
settings.  ``local_session`` is only for tests, the bench and the smoke
entry: it is the one place that chooses a checkpoint folder itself.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "structura") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRUCTURA_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="structura-ckpt-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it; next comes a folder that the caller
    gave to ``setCheckpointDir``.  With neither, a local-mode session gets a
    scratch folder of its own (driver and executors are one process there),
    and any other session is refused: a folder local to one machine would
    be invisible to the executors.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if current:
        return current.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="structura-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove one intermediate table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
