"""Sharding by a hierarchical weighted hash tree (operator 7).

A row descends region, rack and shard.  At every node each child draws
``-ln(u) / weight`` from a hash of (key, child name) and the smallest draw
wins, so a child is chosen in proportion to its weight and, when weights
change, rows move only into children that grew or out of children that
shrank.  The draw of a child depends on its own name alone, so nothing
moves inside subtrees whose weights stay as they were.

Law ``key``: the id and the tree decide, nothing else.  Adding a shard in
a region of its own leaves the weights of all old subtrees alone; rows
then move into the new shard only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, shuffle_partitions


@dataclass(frozen=True)
class Level:
    """A node of the tree: its kind, and its children or (a leaf) its weight."""

    kind: str
    below: list[Level] | float

    @property
    def weight(self) -> float:
        return self.below if isinstance(self.below, float) else sum(x.weight for x in self.below)

    @property
    def leaves(self) -> int:
        return 1 if isinstance(self.below, float) else sum(x.leaves for x in self.below)


def draw(key: Column, name: str, weight: float) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from 53 bits of the hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def shard_column(key: Column, tree: list[Level]) -> Column:
    """Shard number of ``key``: leaves are numbered from 0 in tree order.

    A child's name is its path of positions, so a child appended at the end
    of a list renames none of its siblings.  Children of weight 0 get no rows.
    """
    def descend(nodes: list[Level], path: str, first: int) -> Column:
        options, numbers = [], []
        for i, node in enumerate(nodes):
            name = f"{path}/{node.kind}{i}"
            if node.weight > 0:
                options.append((draw(key, name, node.weight),
                                F.lit(first) if isinstance(node.below, float) else descend(node.below, name, first)))
            first += node.leaves
        if not options:
            raise ValueError(f"no child with a weight under {path or 'the root'}")
        if len(options) == 1:
            return options[0][1]
        least = F.least(*[d for d, _ in options])
        out = options[-1][1]
        for d, number in reversed(options[:-1]):
            out = F.when(d == least, number).otherwise(out)
        return out

    return descend(tree, "", 0).cast("int")


def assign_shards(docs: DataFrame, tree: list[Level], grown: list[Level] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``size``: UTF-8 bytes of the text plus 1; a null text counts as empty.
    ``slot``: place within the shard, gapless from 0, by id, size and CRC;
    rows equal in all three share no slot but their order is arbitrary.  A
    null id is a key of its own.  Repeated ids go to one shard.  Other
    columns are ignored.  An empty table gives no rows.

    Slots need no task per shard: rows are range-partitioned by (shard, id,
    ...), numbered inside their partition, and shifted by the row counts of
    the partitions before (a table of at most partitions x shards rows).
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        shard_column(key, tree).alias("shard"),
        (shard_column(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    order = ["shard", "doc_id", "size", "text_crc32"]
    scratch = Scratch(spark, "sharding")
    placed = scratch.save(
        scratch.save(rows, "rows").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()), "placed")
    scratch.drop("rows")
    part = F.shiftright("at", 33)
    runs = placed.groupBy(part.alias("part"), "shard").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "shard", (before - F.col("first_at")).alias("shift"))
    return (placed.withColumn("part", part).join(F.broadcast(runs), ["part", "shard"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("at") + F.col("shift")).alias("slot"), "grown_shard"))
