"""Columns that are worked out once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` with every column worked out once per row.

    Catalyst merges projections, and a column that a lambda reads would be
    worked out again for each element; it does not merge across a generator.
    """
    one = F.array(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(F.explode_outer(one).alias("_s")).select("_s.*")  # outer: no filter is inferred that would repeat the work


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
