"""SimHash near-duplicate detection with bit-sliced comparison (operator 3).

Fingerprints: 64 bits by majority over the XXH64 of all word shingles.
Candidates: the 64 bits are cut into ``radius + 3`` blocks; fingerprints
at most ``radius`` bits apart agree in at least three of them, so each
fingerprint goes to one bucket per choice of three blocks.  A bucket that
is too large is cut again: its members differ in the other blocks only,
these are cut into ``radius + 1`` pieces, and one piece must agree.  No
pair is lost by that, and no bucket is capped.

Comparison: a block of fingerprints is stored as 64 vertical bit planes.
The planes are XORed against a query plane by plane, and two carry-save
counter planes and one overflow plane hold the distances of all lanes at
once; a block is abandoned as soon as every lane is over the radius.

Links join distinct fingerprints; components are found by star
contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, ship_package, small_enough, utf8_bytes
from .components import star_components

BITS = 64
#: Rows of a bucket beyond which it is cut again.
WIDE_BUCKET = 2_048
#: Lanes compared at once; bounds the planes in memory.
LANES = 1 << 15

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text; see :func:`fingerprints`."""
    return int(fingerprints([text], shingle, seed)[0])


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints.

    A-Z are lower-cased, words are runs of non-white-space bytes, shingles
    are ``shingle`` words joined by a space, repeats included; fewer words
    make one shingle, none give zero.  A bit is set if more than half of
    the shingles' hashes have it.
    """
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            out[row] = digest(b" ".join(words), seed)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
        ends = ends[shingle - 1:].tolist()
        hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64, len(ends))
        out[row] = _majority(hashes)
    return out


def _majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at:at + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def planes(prints: np.ndarray) -> np.ndarray:
    """Vertical bit planes: row i holds bit i of all fingerprints, 64 lanes to a word."""
    lanes = -(-len(prints) // BITS) * BITS
    padded = np.zeros(lanes, "<u8")
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(block: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Lane words (queries x words): bit set where the lane is at most ``radius`` bits from the query.

    ``block``: planes of the lanes.  ``queries``: for each plane the XOR
    operand, of shape (64, queries, 1) or (64, queries, words).  Counters
    are carry-save: ``ones`` and ``twos`` hold the distance modulo 4 and
    ``over`` latches lanes beyond the radius (0 to 3).
    """
    shape = np.broadcast_shapes(queries.shape[1:], (1, block.shape[1]))
    ones, twos, over = (np.zeros(shape, np.uint64) for _ in range(3))
    for i in range(BITS):
        diff = block[i][None, :] ^ queries[i]
        carry = ones & diff
        ones ^= diff
        if radius == 0:
            over |= diff
        elif radius == 1:
            over |= carry
        else:
            over |= twos & carry
            twos ^= carry
            if radius == 2:
                over |= ones & twos
        if i % 8 == 7 and (over == _FULL).all():
            break
    return ~over


def _pairs(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius among rows of equal ``bucket`` (rows sorted by bucket).

    Buckets of up to 64 rows are compared lag by lag, all buckets of the
    block at once; larger ones query by query against the bucket's planes.
    """
    n = len(prints)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [n]))
    sizes = np.diff(starts)
    left, right = [], []
    narrow = np.repeat(sizes <= BITS, sizes)
    rows = np.flatnonzero(narrow)
    for at in range(0, len(rows), LANES):
        part = rows[at:at + LANES + BITS]  # a bucket's rows that reach over the cut are seen from both sides
        p, b = prints[part], bucket[part]
        for lag in range(1, min(BITS, len(part))):
            same = b[:-lag] == b[lag:]
            if not same.any():
                break
            lanes = np.flatnonzero(same)
            if len(lanes) * 4 < len(same):  # few lanes left: their own planes
                near = within(planes(p[lanes]), planes(p[lanes + lag])[:, None, :], radius)
                hit = lanes[_lanes(near[0], len(lanes))]
            else:
                near = within(planes(p[:-lag]), planes(p[lag:])[:, None, :], radius)
                hit = np.flatnonzero(_mask(near[0], len(same)) & same)
            left.append(part[hit])
            right.append(part[hit + lag])
    for k in np.flatnonzero(sizes > BITS):
        a, z = starts[k], starts[k + 1]
        for low in range(a, z, LANES):
            high = min(low + LANES, z)
            block = planes(prints[low:high])
            step = max(1, (1 << 20) // block.shape[1])
            for q in range(a, high, step):
                ask = prints[q:min(q + step, high)]
                bits = np.unpackbits(ask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool)
                near = within(block, np.where(bits, _FULL, np.uint64(0))[:, :, None], radius)
                who = np.flatnonzero(near.any(axis=1))
                for w in who:
                    hit = low + _lanes(near[w], high - low)
                    hit = hit[hit > q + w]
                    left.append(np.full(len(hit), q + w))
                    right.append(hit)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _mask(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[:n].astype(bool)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(_mask(words, n))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the least row reachable over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _compare(radius: int):
    """Rows ``(bucket, print)`` sorted by bucket -> links from fingerprints to the least one that they reach in the bucket."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in parts:
            held_b = np.concatenate((held_b, part.column(0).to_numpy()))
            held_p = np.concatenate((held_p, part.column(1).to_numpy()))
            cut = np.searchsorted(held_b, held_b[-1]) if len(held_b) else 0
            if cut >= LANES:
                yield links(held_p[:cut], held_b[:cut])
                held_b, held_p = held_b[cut:], held_p[cut:]
        if len(held_b):
            yield links(held_p, held_b)

    def links(signed: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        a, b = _pairs(signed.view(np.uint64), bucket, radius)
        root = _forest(a, b, len(signed))
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(signed[far]), pa.array(signed[root[far]])], schema=_EDGE)

    return run


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` runs (first bit, bits) that share out ``width`` bits."""
    edges = [width * k // parts for k in range(parts + 1)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def links(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``print``, long) that connect all those within ``radius`` bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the carry-save counters hold radii from 0 to 3")
    blocks = _cuts(BITS, radius + 3)
    choices = list(combinations(range(len(blocks)), 3))

    def masked(bits: list[int]):
        mask = sum(1 << i for i in bits)
        return F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    def run(first: int, width: int) -> list[int]:
        return list(range(first, first + width))

    keys = [(t, [i for b in choice for i in run(*blocks[b])]) for t, choice in enumerate(choices)]
    first = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), masked(bits).alias("key")) for t, bits in keys])).alias("k")).select("print", "k.t", "k.key")
    sizes = scratch.save(first.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    found = scratch.save(first.join(sizes, ["t", "key"]), "candidates")
    scratch.drop("buckets")
    narrow = found.filter(F.col("n") <= WIDE_BUCKET).select("t", "key", F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("rest"), "print")
    # a wide bucket is cut by the bits outside its key
    pieces = []
    for t, bits in keys:
        other = [i for i in range(BITS) if i not in set(bits)]
        pieces.append(F.array(*[F.struct(F.lit(k).alias("piece"), masked(other[a:a + w]).alias("rest"))
                                for k, (a, w) in enumerate(_cuts(len(other), radius + 1))]))
    piece = pieces[0]
    for t, p in list(enumerate(pieces))[1:]:
        piece = F.when(F.col("t") == t, p).otherwise(piece)
    wide = found.filter(F.col("n") > WIDE_BUCKET).select("t", "key", F.explode(piece).alias("p"), "print").select(
        "t", "key", "p.piece", "p.rest", "print")
    rows = narrow.unionByName(wide).select(F.xxhash64("t", "key", "piece", "rest").alias("bucket"), "print")
    # two buckets that share a hash are compared as one: more comparisons, the same links
    edges = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(radius), "a long, b long")
    edges = scratch.save(edges.distinct(), "links")
    scratch.drop("candidates")
    return edges


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``.

    Two rows link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable over links.  A null or
    empty text has fingerprint zero and links like any other.  A null id
    gets a component like any row but never names one, unless its component
    has no other id (then the name is null).  Repeated rows are returned as
    often as they come.  Other columns are ignored; an empty table gives no
    rows.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = fingerprints(utf8_bytes(part.column(1)), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made)], names=["doc_id", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (_labelled(scratch.save(rows.mapInArrow(run, "doc_id long, print long"), "prints"), radius, scratch)
            .select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"))


def _labelled(rows: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``doc_id, print, component_id, first_print``: one row per row of ``rows`` (``doc_id, print``, a written table).

    ``first_print`` names the component, which a null or repeated id
    doesn't: of the fingerprints that have the component's smallest id
    the smallest.
    """
    owners = scratch.save(rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "owners")
    edges = links(owners.select("print"), radius, scratch)
    member = scratch.save(star_components(edges.select("a", "b"), scratch), "members")
    scratch.drop("links")
    # only fingerprints with a link are in `member`; the others are components of their own
    linked = member.select(F.col("a").alias("print"), F.col("b").alias("root")).unionByName(
        member.select(F.col("b").alias("print"), F.col("b").alias("root")).distinct())
    named = linked.join(owners, "print")
    first = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "print")
    names = named.groupBy("root").agg(F.min(first).alias("first"))
    named = named.join(names, "root").select("print", F.col("first.least_id").alias("component_id"), F.col("first.print").alias("first_print"))
    named = scratch.save(named, "named")
    owners = owners.join(named, "print", "left").select("print", F.coalesce("component_id", "least_id").alias("component_id"),
                                                        F.coalesce("first_print", "print").alias("first_print"), "n")
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return (join_groups(rows, scratch.save(owners, "groups"), "print", "n", total)
            .select("doc_id", "print", "component_id", "first_print"))


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, all columns as they were.

    It has the component's smallest id (none, where no row has one) and of
    the fingerprints with that id the smallest; of rows equal in both the
    one with the least text stays.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash-drops")
    # the rows are written with their fingerprints, which every later step reads
    seen = scratch.save(docs.withColumn(_OWN, _print_column(shingle)(F.col(text_col).cast("string"))), "rows", compression="zstd")
    rows = _labelled(seen.select(F.col(id_col).cast("long").alias("doc_id"), F.col(_OWN).alias("print")), radius, scratch)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("print") == F.col("first_print"))
    changed = rows.groupBy("doc_id", "print").agg(F.max(stays).alias("stays"), F.count("*").alias("copies"))
    changed = scratch.save(changed.filter("not stays or copies > 1").select(
        F.col("doc_id").alias(_ID), F.col("print").alias(_PRINT), F.col("stays").alias(_STAYS)), "changed")
    n = changed.count()
    if not n:
        return seen.select(*docs.columns)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(_ID)) & (F.col(_OWN) == F.col(_PRINT))
    left = seen.join(small_enough(changed, n, 32), same, "left_anti").select(*docs.columns)
    repeated = changed.filter(_STAYS)
    n = repeated.count()
    if not n:
        return left
    one = seen.join(small_enough(repeated, n, 32), same).groupBy(_ID, _PRINT).agg(
        F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(_ROW))
    return left.unionByName(one.select(f"{_ROW}.*"))


def _print_column(shingle: int, seed: int = 42):
    """Fingerprint of a text column, as a long."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(utf8_bytes(texts), shingle, seed).view(np.int64))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")


#: Names that no column of a caller's table has.
_ID, _PRINT, _STAYS = "structura_gone_id", "structura_gone_print", "structura_gone_stays"
_OWN, _ROW = "structura_own_print", "structura_row"
