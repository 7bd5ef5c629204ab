"""Exact deduplication behind static binary-fuse filters (operator 6).

The rows come in batches by id.  Every batch that has been taken in is an
immutable snapshot: a table of its new digests with the row that stays,
and one static binary-fuse filter per digest shard.  An incoming batch is
first grouped by digest (its own duplicates); the filters of all earlier
snapshots screen the groups; only positives join the snapshots' exact
buckets.  Texts of all groups of two or more are then compared byte by
byte, and a digest that two different texts share is split by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import SPACES, Scratch, join_groups, ship_package, small_enough

#: Digests in one shard of a snapshot, as the target: bounds what one filter holds in memory.
SHARD_DIGESTS = 8_192

_FILTERS = "shard int, kind int, digest binary, keep_id long, n long, seed binary, segment long, windows long, cells binary"
_FILTERS_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()),
                            ("n", pa.int64()), ("seed", pa.binary()), ("segment", pa.int64()), ("windows", pa.int64()),
                            ("cells", pa.binary())])
_SCREENED = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()), ("hit", pa.bool_())])


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; a null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keys(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest (zero-padded) as filter key."""
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), "<u8").astype(np.uint64)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> one filter row per shard."""
    def out(shard: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        f = fuse.build(np.concatenate(keys))
        row = {"shard": [shard], "kind": [0], "digest": [None], "keep_id": [None], "n": [None],
               "seed": [f.seed.to_bytes(8, "little")], "segment": [f.segment], "windows": [f.windows], "cells": [f.cells.tobytes()]}
        return pa.RecordBatch.from_pydict(row, schema=_FILTERS_ARROW)

    now, held = None, []
    for part in parts:
        shards = part.column("shard").to_numpy(zero_copy_only=False)
        keys = _keys(part.column("digest").to_pylist())
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if shards[a] != now and held:
                yield out(int(now), held)
                held = []
            now = shards[a]
            held.append(keys[a:b])
    if held:
        yield out(int(now), held)


def _screen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, kind): a shard's filters (kind 0), then its digests (kind 1)."""
    now, filters = None, []
    for part in parts:
        shards = part.column("shard").to_pylist()
        kinds = part.column("kind").to_pylist()
        digests = part.column("digest")
        hit = np.zeros(len(shards), bool)
        start = 0
        while start < len(shards):
            if shards[start] != now:
                now, filters = shards[start], []
            if kinds[start] == 0:
                r = part.slice(start, 1).to_pylist()[0]
                filters.append(fuse.FuseFilter(int.from_bytes(r["seed"], "little"), r["segment"], r["windows"], np.frombuffer(r["cells"], np.uint8)))
                start += 1
                continue
            end = start
            while end < len(shards) and shards[end] == now and kinds[end] == 1:
                end += 1
            keys = _keys(digests.slice(start, end - start).to_pylist())
            for f in filters:
                hit[start:end] |= f.contains(keys)
            start = end
        mine = pa.array(np.array(kinds) == 1) if kinds else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([digests, part.column("keep_id"), part.column("n"), pa.array(hit)], schema=_SCREENED).filter(mine)


def _digested(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _sha(norm).alias("sha")).withColumn(
        "digest", F.substring("sha", 1, digest_bytes))


def duplicate_groups(docs: DataFrame, snapshots: int = 3, id_col: str = "doc_id", text_col: str = "text",
                     digest_bytes: int = 32) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, filter_hits``: one row per row of ``docs``.

    Texts are equal when identical after white-space runs become one space;
    a null text counts as empty.  The smallest id of a group stays.  Rows
    repeated with the same id and text count each, and one of them stays;
    a null id stays only where no row of its group has an id (then one
    does).  ``filter_hits``: digests of the row's group that a filter let
    through to the exact buckets.  Other columns are ignored; an empty
    table gives no rows.  ``digest_bytes`` below 32 only makes digests
    collide more often; the byte check keeps the result the same.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.save(_digested(docs, id_col, text_col, digest_bytes), "digests")
    total = rows.count()
    shards = max(1, -(-total // SHARD_DIGESTS))
    at = [k / snapshots for k in range(1, snapshots)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", at, 1000)).first()[0] or [])) if at else []
    batch = F.lit(0)
    for k, cut in enumerate(cuts):
        batch = F.when(F.col("doc_id") > cut, k + 1).otherwise(batch)
    batch = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(batch)

    filters = buckets = found = None
    for k in range(len(cuts) + 1):
        own = (rows.filter(batch == k).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")))
        own = own.withColumn("hit", F.lit(False))
        if filters is not None:
            probe = own.select(_shard(shards).alias("shard"), F.lit(1).alias("kind"), "digest", "keep_id", "n").unionByName(
                filters, allowMissingColumns=True).select(*_FILTERS_ARROW.names)
            # digests are distinct here, and a shard holds a bounded number of them
            probe = probe.repartition("shard").sortWithinPartitions("shard", "kind")
            screened = probe.mapInArrow(_screen, "digest binary, keep_id long, n long, hit boolean")
            own = scratch.save(screened, f"screened{k}")
            known = own.filter("hit").join(buckets.select("digest", F.col("keep_id").alias("old_id")), "digest")
            known = scratch.save(known.select("digest", F.col("old_id").alias("keep_id"), "n", "hit"), f"known{k}")
            fresh = own.join(known.select("digest"), "digest", "left_anti")
        else:
            known, fresh = None, own
        fresh = scratch.save(fresh.select("digest", "keep_id", "n", "hit"), f"snapshot{k}")
        buckets = fresh if buckets is None else buckets.unionByName(fresh)
        done = fresh if known is None else fresh.unionByName(known)
        found = done if found is None else found.unionByName(done)
        if k < len(cuts):
            built = (fresh.select(_shard(shards).alias("shard"), "digest").repartition("shard").sortWithinPartitions("shard")
                     .mapInArrow(_build, _FILTERS))
            built = scratch.save(built, f"filters{k}")
            filters = built if filters is None else filters.unionByName(built)

    groups = scratch.save(found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"),
                                                      F.sum(F.col("hit").cast("long")).alias("filter_hits")), "groups")
    counted = rows.groupBy("doc_id", "sha", "digest").agg(F.count("*").alias("copies"))
    decided = scratch.save(join_groups(counted, groups, "digest", "group_size", total).select("digest", *_DECIDED), "decided")
    decided = _byte_check(docs, decided, scratch, id_col, text_col, digest_bytes)
    return (decided.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "filter_hits"))


_DECIDED = ["doc_id", "sha", "copies", "keep_id", "group_size", "filter_hits"]


def _byte_check(docs: DataFrame, decided: DataFrame, scratch: Scratch, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """``decided`` with every group split whose texts are not all the same bytes.

    Only texts of groups of two or more are read again.  All texts of a
    group are equal when its least and greatest text are, so copies meet
    as partial aggregates and no group is gathered.
    """
    members = scratch.save(decided.filter("group_size > 1").select("doc_id", "digest").distinct(), "members")
    asked = small_enough(members, members.count(), 48)
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
             .join(asked, F.col("id").eqNullSafe(F.col("doc_id")))
             .withColumn("norm", normalised(F.col("text"))).withColumn("sha", _sha(F.col("norm")))
             .filter(F.substring("sha", 1, digest_bytes) == F.col("digest")).select("doc_id", "digest", "sha", "norm"))
    spread = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    unequal = scratch.save(spread.filter("least <> most").select("digest"), "unequal")
    n = unequal.count()
    if not n:
        return decided.select(*_DECIDED)
    few = small_enough(unequal, n, 48)
    apart = texts.join(few, "digest", "left_semi")
    subgroups = apart.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    per_row = apart.groupBy("doc_id", "digest", "sha", "norm").agg(F.count("*").alias("copies"))
    hits = decided.select("digest", "filter_hits").distinct()
    split = per_row.join(subgroups, ["digest", "norm"]).join(hits, "digest")
    return decided.join(few, "digest", "left_anti").select(*_DECIDED).unionByName(split.select(*_DECIDED))


def drop_duplicates(docs: DataFrame, snapshots: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they were.

    Of rows repeated with the same id and text one stays, whichever.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup-drops")
    decided = scratch.save(duplicate_groups(docs, snapshots, id_col, text_col), "decided")
    changed = decided.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("stays"), F.count("*").alias("copies"), F.max("group_size").alias("size"))
    changed = scratch.save(changed.filter("size > 1 and (not stays or copies > 1)").select(
        F.col("doc_id").alias(_ID), F.col("text_sha256").alias(_SHA), F.col("stays").alias(_STAYS)), "changed")
    n = changed.count()
    if not n:
        return docs
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(_ID)) & (sha == F.col(_SHA))
    left = docs.join(small_enough(changed, n, 96), same, "left_anti")
    repeated = changed.filter(_STAYS)
    n = repeated.count()
    if not n:
        return left
    one = docs.join(small_enough(repeated, n, 96), same)
    return left.unionByName(one.dropDuplicates([_ID, _SHA]).select(*[one[c] for c in docs.columns]))


#: Names that no column of a caller's table has.
_ID, _SHA, _STAYS = "structura_changed_id", "structura_changed_sha", "structura_changed_stays"
