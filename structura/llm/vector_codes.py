"""Product codes of vectors by a trie over their distinct parts (operator 13).

Components become integers, vectors are cut into equal parts, and every
part position has a codebook of a few entries.  The distinct parts of a
position, in lexicographic order, are the leaves of a trie: depth-first, a
node's vector of squared distances to all entries is its parent's plus one
dimension, so parts that begin alike share that work.  A leaf takes the
nearest entry and adds its part, weighted by how often it occurs, to the
entry's sum.

The distinct parts are found once, by one partial aggregate, and written in
range partitions: a task holds a stretch of a position's trie.  A round
reads them, and only sums per entry leave the tasks.  All arithmetic is in
integers, so results don't depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, join_groups, ship_package, shuffle_partitions

#: Leaves whose nodes are extended together.
RUN = 8_192

Codebooks = dict[int, np.ndarray]  # by vector length: (parts, entries, width)

_SUMS = pa.schema([("dims", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64()), ("codebooks_sha256", pa.string())])


class Traversal:
    """Depth-first walk over a trie whose leaves come in lexicographic order, in runs."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        count, width = entries.shape
        #: The last leaf, and the distances accumulated along the path to it.
        self.last: np.ndarray | None = None
        self.path = [np.zeros(count, np.int64) for _ in range(width + 1)]
        #: Nodes worked out so far.
        self.nodes = 0

    def __call__(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the first on ties) and squared distance for each of the next leaves; repeated leaves share a node."""
        found = [self._run(leaves[at:at + RUN]) for at in range(0, len(leaves), RUN)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(e for e, _ in found)]), np.concatenate([none, *(d for _, d in found)])

    def _run(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = leaves.shape[1]
        before = np.concatenate((leaves[:1] if self.last is None else self.last[None], leaves[:-1]))
        differs = leaves != before
        # the depth at which a leaf's path leaves that of the leaf before
        fork = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else np.zeros(len(leaves), np.int64)
        if self.last is None:
            fork[0] = 0
        above, parent, path = self.path[0][None], np.zeros(len(leaves), np.int64), [self.path[0]]
        for d in range(width):
            new = fork <= d
            first = np.flatnonzero(new)
            step = leaves[first, d][:, None] - self.entries[None, :, d]
            here = above[parent[first]] + step * step
            self.nodes += len(first)
            if not new[0]:  # the run begins below a node of the run before
                here = np.concatenate((self.path[d + 1][None], here))
            node = np.cumsum(new) - int(new[0])
            path.append(here[node[-1]])
            above, parent = here, node
        self.last, self.path = leaves[-1], path
        best = above.argmin(axis=1)
        return best[parent], above[np.arange(len(above)), best][parent]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _partial_sums(books: Codebooks):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct parts ``(dims, part, piece, n)`` in order -> counts and sums by entry."""
        walks: dict[tuple[int, int], Traversal] = {}
        totals: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in parts:
            dims, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                if lo == hi:
                    continue
                key = int(dims[lo]), int(part[lo])
                entries = books[key[0]][key[1]]
                if key not in walks:
                    walks = {key: Traversal(entries)}  # within a file keys come in order: an earlier walk is done
                totals.setdefault(key, (np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)))
                leaves, n = _matrix(batch.column(2).slice(lo, hi - lo), entries.shape[1]), batch.column(3).slice(lo, hi - lo).to_numpy()
                entry, _ = walks[key](leaves)
                count, sums = totals[key]
                np.add.at(count, entry, n)
                np.add.at(sums, entry, leaves * n[:, None])
        out = [(*key, e, int(count[e]), sums[e].tolist()) for key, (count, sums) in totals.items() for e in np.flatnonzero(count).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUMS, strict=True)], schema=_SUMS)

    return run


def _coder(books: Codebooks):
    digests = {dims: codebook_digest(book) for dims, book in books.items()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors ``(vec_id, label, dims, cells)`` -> codes; a batch's distinct parts make its tries."""
        for batch in parts:
            n = batch.num_rows
            dims = batch.column(2).to_numpy()
            code, error = np.empty(n, object), np.zeros(n, np.int64)
            for length in np.unique(dims).tolist():
                book = books[length]
                count, _, width = book.shape
                at = np.flatnonzero(dims == length)
                x = _matrix(batch.column(3).take(pa.array(at)), count * width)
                entries = np.empty((len(at), count), np.int64)
                for part in range(count):
                    piece = x[:, part * width:(part + 1) * width]
                    order = np.lexsort(piece.T[::-1]) if width else np.arange(len(at))
                    entries[order, part], distance = Traversal(book[part])(piece[order])
                    error[at[order]] += distance
                code[at] = ["".join(f"{e:02x}" for e in row) for row in entries.tolist()]
            sha = [digests[d] for d in dims.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error), pa.array(sha, pa.string())], schema=_CODES)

    return run


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, parts: int, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, dims, cells``: vectors without null or non-finite components as integers, padded with zeros to whole parts."""
    vec = F.col(vec_col)
    odd = F.exists(vec, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    padding = F.pmod(-F.size(vec), F.lit(parts))
    cells = F.concat(F.transform(vec, lambda v: F.floor(v.cast("double") * scale).cast("long")), F.array_repeat(F.lit(0).cast("long"), padding.cast("int")))
    return vectors.filter(vec.isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.size(vec).alias("dims"), cells.alias("cells"))


def _pieces(cells: Column, parts: int) -> Column:
    width = (F.size(cells) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(cells, p * width + 1, width))


def train(vectors: DataFrame, scratch: Scratch, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks of the integer vectors, by vector length.

    They begin as the parts of the ``entries`` smallest ids (null ids last,
    ties by the vector).  A round assigns every part to the nearest entry
    (ties to the lower) and moves an entry to the floor of its parts' mean;
    entries without parts stay.  What reaches the driver has ``parts *
    entries`` rows per vector length and round.
    """
    spark = vectors.sparkSession
    place = F.row_number().over(W.partitionBy("dims").orderBy(F.col("vec_id").asc_nulls_last(), "cells"))
    books: Codebooks = {}
    first: dict[int, list] = {}
    for r in vectors.withColumn("place", place).filter(F.col("place") <= entries).orderBy("dims", "place").collect():
        first.setdefault(r.dims, []).append(r.cells)
    for dims, rows in first.items():
        books[dims] = np.array(rows, np.int64).reshape(len(rows), parts, -1 if rows[0] else 0).transpose(1, 0, 2).copy()
    if not books:
        return books
    pieces = vectors.select("dims", F.posexplode(_pieces(F.col("cells"), parts)).alias("part", "piece"))
    distinct = scratch.save(pieces.groupBy("dims", "part", "piece").agg(F.count("*").alias("n")), "distinct")
    order = ["dims", "part", "piece"]
    leaves = scratch.save(distinct.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order), "leaves")
    scratch.drop("distinct")
    for _ in range(rounds):
        summed = leaves.mapInArrow(_partial_sums(books), "dims int, part int, entry int, n long, sums array<long>")
        exact = "decimal(38,0)"
        cells = summed.select("dims", "part", "entry", "n", F.posexplode_outer("sums").alias("at", "x"))
        moved = (cells.groupBy("dims", "part", "entry", "at").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x")))
        for r in moved.filter("at is not null").collect():
            books[r.dims][r.part, r.entry, r.at] = int(r.x) // int(r.n)
    scratch.drop("leaves")
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256`` for every integer vector; ``label`` is its text."""
    ship_package(vectors.sparkSession)
    return vectors.select("vec_id", "label", "dims", "cells").mapInArrow(
        _coder(books), "vec_id long, label string, code string, error long, codebooks_sha256 string")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every vector without null or non-finite components.

    ``code``: the entry of every part, two hex digits each.  ``error``:
    squared distances summed over the parts.  ``label_error``: that, summed
    over equal labels; null labels together.  Vectors of different lengths
    have no distance: each length has codebooks of its own.  A length that
    is no multiple of ``parts`` is filled up with zeros; an empty vector
    has empty parts and no error.  Repeated ids and rows are coded each; null
    ids stay.  With fewer vectors than ``entries`` a codebook has as many
    entries as there are vectors.  Other columns are ignored; an empty
    table gives no rows.  Components so large that squared distances could
    leave 64 bits raise ValueError.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries from 1 to 256 and at least one part")
    ship_package(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "codes")
    kept = scratch.save(integer_vectors(vectors, parts, scale, id_col, vec_col, label_col), "vectors")
    largest = F.max(F.coalesce(F.array_max(F.transform("cells", lambda x: F.greatest(x, -x).cast("double"))), F.lit(0.0)))
    for r in kept.groupBy("dims").agg(largest.alias("x")).collect():
        if 4 * r.x * r.x * max(1, r.dims) >= 2.0 ** 63:
            raise ValueError(f"components up to {r.x / scale:g} are too large for exact 64-bit distances")
    coded = scratch.save(encode(kept, train(kept, scratch, parts, entries, rounds)), "coded")
    scratch.drop("vectors")
    key = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit(""))
    keyed = coded.withColumn("key", key)
    sums = scratch.save(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return join_groups(keyed, sums, "key", "n", coded.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The query in DuckDB's SQL: every part against every entry."""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, CAST(part AS BIGINT) AS part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS y FROM v, range({parts}) AS r(part)
), c0 AS MATERIALIZED (
  SELECT part, e, y FROM (SELECT part, y, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {entries}
)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, y, near // {entries} AS d, near % {entries} AS e FROM (
    SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.y) AS y,
           min(CAST(list_sum(list_transform(list_zip(p.y, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {entries} + c.e) AS near
    FROM p JOIN c{k} AS c ON p.part = c.part GROUP BY p.vec_id, p.part)
)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.y, c.y) AS y FROM c{k} AS c LEFT JOIN (
    SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM (
      SELECT part, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT part, e, unnest(y) AS x, generate_subscripts(y, 1) AS i FROM a{k}) GROUP BY part, e, i) GROUP BY part, e
  ) AS m ON m.part = c.part AND m.e = c.e
)""")
    return "WITH " + ", ".join(steps) + f""", b AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (
    SELECT part, e, unnest(y) AS x, generate_subscripts(y, 1) AS i FROM c{rounds})
), f AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, b"""
