"""Connected components of an edge table by alternating star contraction.

Large-star and small-star steps, as published by Kiveris et al.: every
round points nodes at smaller nodes of their neighbourhood; the edges
shrink to one star per component in a logarithmic number of rounds.  Each
round is two joins with a partial aggregate, written to the shared
checkpoint folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``(a, b)`` with a > b; the result is again distinct with a > b."""
    if large:
        hood = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        hood = edges
    least = hood.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m")) if large else least
    near = hood.join(least, "a")
    if large:  # every larger neighbour goes to the least of the neighbourhood
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every smaller neighbour, and the node itself
        out = near.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.filter("a <> b").distinct()


def star_components(edges: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """``(a, b)``: every node of ``edges`` that is not the least of its component, and that least node.

    ``edges``: columns ``a, b`` of one orderable type; direction, repeats
    and loops don't matter.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = scratch.save(now, "edges0"), None
    for k in range(1, rounds + 1):
        n, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not n or (n, mark) == last:
            return now
        last = (n, mark)
        new = scratch.save(_star(_star(now, True), False), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        now = new
    raise ValueError(f"components did not settle in {rounds} rounds")
