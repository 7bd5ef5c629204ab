"""Ranks within groups of any size, by one distributed sort.

``row_number().over(partitionBy(keys).orderBy(...))`` sends a whole group to
one task, and one group may hold most rows.  Here the rows are
range-partitioned by keys and order, numbered inside their partition, and
shifted by the row counts of the group's earlier partitions, a table with at
most one row per group and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .scratch import materialize
from .ship import ship_package

#: As many runs of a group within a partition are broadcast at most; more meet their rows by shuffle.
BROADCAST_RUNS = 100_000


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, keep_order: bool = True) -> DataFrame:
    """``df`` with ``out``: the row's 0-based place within its ``keys`` by ``order`` (any orderable columns).

    ``keep_order`` False: without the columns of ``order``, which then are neither written nor moved again.

    The sorted rows are written once, so the numbers are the same for every reader.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
                         .withColumn("__at", F.monotonically_increasing_id()).drop(*([] if keep_order else order)), "ranked")
    part = F.shiftright("__at", 33)
    runs = materialize(placed.groupBy(*keys, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")), "ranked-runs")
    few = runs.count() <= BROADCAST_RUNS
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return (placed.withColumn("__part", part).join(F.broadcast(runs) if few else runs, [*keys, "__part"])
            .withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift"))


def ranked_in_many(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """As :func:`ranked`, for very many groups of any size.

    A table of the runs of all groups would be about as large as the rows and
    meet them by shuffle.  Here the sorted rows are counted as they pass, and
    only a group that goes on from an earlier partition is shifted: one at
    most per partition.  Every column passes Arrow, so rows should be narrow.
    Rows with a null key are left out, as by ``ranked``.
    """
    spark = df.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    schema = StructType([*df.schema.fields]).add("__nth", LongType()).add("__at", LongType())
    at = [df.columns.index(k) for k in keys]
    placed = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(_counted(at), schema)
    placed = materialize(placed, "ranked").withColumn("__part", F.shiftright("__at", 33))
    row = F.struct(*keys, "__nth")
    ends = placed.groupBy("__part").agg(F.min_by(F.struct(*keys), "__at").alias("__head"), F.max_by(row, "__at").alias("__tail"))
    tail = F.struct(*(F.col(f"__tail.{k}").alias(k) for k in keys))
    # a group's rows before a partition: it ends all partitions that it began in or went through
    sofar = ends.select("__part", "__head", tail.alias("__last"), (F.col("__tail.__nth") + 1).alias("__n"))
    sofar = sofar.withColumn("__n", F.sum("__n").over(Window.partitionBy("__last").orderBy("__part")))
    back = Window.orderBy("__part")  # one row per partition
    shifts = sofar.select("__part", "__head", F.lag("__last").over(back).alias("__last"), F.lag("__n").over(back).alias("__shift"))
    shifts = shifts.filter(F.col("__head") == F.col("__last")).select(F.col("__part").alias("__p"), *(F.col(f"__head.{k}").alias(f"__k{i}") for i, k in enumerate(keys)), "__shift")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"__k{i}")
    return (placed.join(F.broadcast(shifts), same, "left")
            .select(*df.columns, (F.col("__nth") + F.coalesce("__shift", F.lit(0))).alias(out)))


def _counted(keys: list[int]):
    """Adds to rows sorted by the columns ``keys`` their place in their group in this partition, and the row's place."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        last: list | None = None  # the group open at the end of the batch before, ...
        begun = at                # ... and the place of its first row
        for part in parts:
            n = part.num_rows
            if not n:
                continue
            columns = [part.column(k) for k in keys]
            new = np.zeros(n, dtype=bool)
            new[0] = last != [c[0] for c in columns]
            for c in columns:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            places = np.arange(at, at + n)
            starts = np.maximum.accumulate(np.where(new, places, begun))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places - starts), pa.array(places)], names=[*part.schema.names, "__nth", "__at"])
            last, begun, at = [c[n - 1] for c in columns], int(starts[-1]), at + n
    return run
