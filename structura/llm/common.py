"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship_package  # noqa: F401  (for the operators)
from ..session import delete_path, ensure_checkpoint_dir

#: A run of the six ASCII white-space characters, and a word (Java regex).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Intermediate tables of one run, written under the shared checkpoint folder.

    A written table cuts lineage: a lost executor costs a re-read, not a
    recomputation, and every reader sees the same rows.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/structura-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for n in names:
            delete_path(self.spark, f"{self.root}/{n}")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_enough(df: DataFrame, rows: int, row_bytes: int, bound: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` rows of ``row_bytes`` bytes stay under ``bound``.

    ``rows`` must be the counted size of ``df``; over the bound Spark joins
    by shuffle.
    """
    return F.broadcast(df) if rows * row_bytes <= bound else df


def crc_mod(id_col: str, n: int) -> Column:
    """CRC-32 of the id written as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of ``schema``."""
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield _batch(schema, part)
            part = []
    if part:
        yield _batch(schema, part)


def _batch(schema: pa.Schema, part: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def utf8_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, parts: int = 1000) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row per ``key``) where a few keys may hold most rows.

    ``size``: the column of ``groups`` with the number of rows of the key.
    Fewer than ``parts`` keys can have over ``total / parts`` rows each, so
    these are broadcast whatever the data; the rows of all other keys meet
    their group by shuffle.
    """
    hot = groups.filter(F.col(size) * parts > total)
    cold = groups.filter(F.col(size) * parts <= total)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(cold, key))
