"""Joins with one row per group where a few groups may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, parts: int = 1000) -> DataFrame:
    """``rows`` inner-joined with ``facts`` (one row per group, with ``size``, its number of rows).

    Fewer than ``parts`` groups can have over a ``parts``-th of all rows
    each: these are broadcast whatever the data, and the rows of all others
    meet their group by shuffle.  Both tables are read twice: pass written ones.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = facts.filter(F.col(size) * parts > total)
    cold = facts.filter(F.col(size) * parts <= total)
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
    rest = rows.alias("r").join(F.broadcast(hot.select(*keys)).alias("h"), same, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
