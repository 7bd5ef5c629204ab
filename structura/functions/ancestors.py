"""Ancestors of paths, by one distributed sort and no join on a parent.

A join on the parent's path sends all children of one parent to one task.
In the order of their segments paths stand behind their ancestors and a
subtree stands together, so one pass over a sorted range partition with a
stack of open paths finds every ancestor inside the partition.  Those before
the partition lie on the way to the last path of the partition before it:
one path per partition, whose prefixes are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .ship import ship_package

_OUT = "site_id string, path string, value long, near string, above array<long>, __at long"


def _plain(column: pa.Array) -> list:
    """As ``to_pylist``, which makes a scalar object of every value first."""
    if pa.types.is_integer(column.type) and column.null_count:
        return column.to_pylist()  # numpy would make floats of these
    return column.to_numpy(zero_copy_only=False).tolist()


def _walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``site_id, path, value`` -> ``near`` and ``above`` as far as this partition knows, and the row's place."""
    at = TaskContext.get().partitionId() << 33
    site: str | None = None
    names: list[str] = []  # open paths, ...
    heads: list[str] = []  # ... what the paths below them begin with, ...
    values: list[int | None] = []  # ... and their values
    for part in parts:
        near: list[str | None] = []
        above: list[int | None] = []
        sizes = [0]
        for s, path, value in zip(*map(_plain, part.columns[:3]), strict=True):
            if s != site:
                site = s
                names.clear(), heads.clear(), values.clear()
            while heads and not path.startswith(heads[-1]):
                names.pop(), heads.pop(), values.pop()
            near.append(names[-1] if names else None)
            above += values
            sizes.append(len(above))
            names.append(path)
            heads.append(path + "/" if path else "")
            values.append(value)
        n = part.num_rows
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(above, pa.int64()))
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(near, pa.string()), lists, pa.array(np.arange(at, at + n))],
                                         names=["site_id", "path", "value", "near", "above", "__at"])
        at += n


def with_ancestors(rows: DataFrame) -> DataFrame:
    """``site_id, path, value, near, above`` for ``rows`` (``site_id, path, value long``), one row per site and path.

    ``above``: the values of the ancestors among the rows, from the top;
    ``near``: the nearest ancestor's path, null if there is none.  Paths are
    segments joined by '/', none of them empty; '' is an ancestor of all
    others.  A null site is a site of its own; a null value stays in
    ``above``.  Only the list of a row's own ancestors grows with the depth;
    the number of children of a path is not bounded by a task.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segs = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    placed = rows.select(F.col("site_id").cast("string").alias("site_id"), "path", F.col("value").cast("long").alias("value"))
    placed = (placed.repartitionByRange(n, "site_id", segs).withColumn("__segs", segs)  # only the path is moved
              .sortWithinPartitions("site_id", "__segs")
              .select("site_id", "path", "value").mapInArrow(_walk, _OUT))
    placed = materialize(placed, "ancestors").withColumn("__part", F.shiftright("__at", 33))
    # one row per partition: the paths that may be open at its start
    last = placed.groupBy("__part").agg(F.max("__at").alias("__at")).select("__at")  # no path is compared or copied for each row
    ends = placed.select("__part", "__at", F.struct("site_id", "path").alias("end")).join(F.broadcast(last), "__at")
    ends = ends.select("__part", F.lag("end").over(Window.orderBy("__part")).alias("end")).filter("end is not null")
    segs = F.split("end.path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda k: F.array_join(F.slice(segs, F.lit(1), k), "/"))
    opened = ends.select("__part", F.col("end.site_id").alias("site"), F.explode(F.array_distinct(prefixes)).alias("open"))
    found = (placed.select("site_id", "path", "value").join(F.broadcast(opened), F.col("site_id").eqNullSafe(F.col("site")) & (F.col("path") == F.col("open")))
             .groupBy("__part", "site").agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), "path", "value"))).alias("opened")))
    both = placed.join(F.broadcast(found.withColumnRenamed("__part", "p")),
                       (F.col("__part") == F.col("p")) & F.col("site_id").eqNullSafe(F.col("site")), "left")
    before = F.filter("opened", lambda o: (o["path"] != F.col("path")) & ((o["path"] == "") | F.startswith(F.col("path"), F.concat(o["path"], F.lit("/")))))
    before = F.coalesce(before, F.array().cast("array<struct<n:int,path:string,value:bigint>>"))
    return both.withColumn("before", before).select(
        "site_id", "path", "value", F.coalesce("near", F.try_element_at("before", F.lit(-1))["path"]).alias("near"),
        F.concat(F.transform("before", lambda o: o["value"]), "above").alias("above"))
