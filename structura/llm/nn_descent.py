"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 4).

Nearness is the inner product.  Distinct vectors are the nodes of a
directed graph of each node's ``graph_k`` nearest.

* Start: random hyperplanes (thresholds at the medians of a bounded
  sample) give every node one code per tree; rows sorted by (tree, code)
  are cut into blocks, and the nearest within a block are first edges.
* Descent: a Spark join brings the vectors of a centre's neighbours, in
  both directions, together; every two of them are tried as neighbours of
  each other, once: later rounds try pairs with an edge that is new.  A
  centre with many reverse neighbours is split by a salt, another one every
  round, so no group grows with the data; all pairs of its parts are tried.
  Rounds follow until hardly an edge changes.
* Search: a query's beam is expanded by its best unexpanded nodes until
  the beam's head has no such node.  Requests travel to cells of nodes
  (a hash of the node), so a query's vector moves once per cell and not
  once per candidate.

Directions are compared in half precision; the beam is scored again in
double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count as count_up

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, join_groups, ship_package, shuffle_partitions

#: Rows of the sample that hyperplane thresholds are fitted on.
SAMPLE_ROWS = 4_000
#: Rows of a block, and nearest kept per row, tree and block.
BLOCK, BLOCK_K = 2_048, 16
#: Members of a centre that meet in one local join.
MEET = 96
#: Nodes of one cell, as the target.
CELL_NODES = 2_048
_FOLD_ROWS = 1 << 21

_EDGES = pa.schema([("node", pa.int64()), ("near", pa.int64()), ("score", pa.float32()), ("fresh", pa.bool_())])
_EDGES_SQL = "node long, near long, score float, fresh boolean"


def _valid(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, vector)`` -> ``(id, size, data)``: only whole, finite, non-zero vectors, as float64 bytes."""
    for part in parts:
        ids, sizes, data = [], [], []
        for i, v in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            values = v.values
            if values is None or values.null_count or not len(values):
                continue
            x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                sizes.append(len(x))
                data.append(x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "size", "data"])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), kind)


def _half(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the direction in half precision and the norm."""
    for part in parts:
        if not part.num_rows:
            continue
        x = _matrix(part.column(1), "<f8")
        norm = np.linalg.norm(x, axis=1)
        unit = (x / norm[:, None]).astype("<f2")
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(norm.astype(np.float32))], names=["node", "half", "norm"])


def _fresh(node: np.ndarray, near: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Edges as found: new until they have been through a round."""
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(near), pa.array(score.astype(np.float32)), pa.array(np.ones(len(node), bool))], schema=_EDGES)


def _fold(node: np.ndarray, near: np.ndarray, score: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest per node, each once, best first; ties go to the smaller id.  An edge found again stays old."""
    order = np.lexsort((-score, fresh, near, node))
    node, near, score, fresh = node[order], near[order], score[order], fresh[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
    node, near, score, fresh = node[first], near[first], score[first], fresh[first]
    order = np.lexsort((near, -score, node))
    node, near, score, fresh = node[order], near[order], score[order], fresh[order]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    keep = rank < k
    return node[keep], near[keep], score[keep], fresh[keep]


def _folding(k: int):
    """Edges of a task -> the ``k`` nearest of each of its nodes."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, folded = 0, 0
        for part in parts:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in part.columns))
            size += part.num_rows
            if size > folded + _FOLD_ROWS:
                held = [_fold(*(np.concatenate(c) for c in zip(*held, strict=True)), k)]
                size = folded = len(held[0][0])
        if held:
            out = _fold(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            for at in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 16)]) for c in out], schema=_EDGES)
    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every node; tasks fold before the shuffle, so a hub moves ``k`` rows per task."""
    folded = edges.mapInArrow(_folding(k), _EDGES_SQL)
    return folded.repartition("node").mapInArrow(_folding(k), _EDGES_SQL)


def _coded(planes: np.ndarray, cuts: np.ndarray, trees: int):
    """One row per node and tree, with the code of the node's side of every hyperplane."""
    bits = planes.shape[1] // trees
    weight = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            side = (_matrix(part.column(1), "<f2").astype(np.float32) @ planes) > cuts
            codes = (side.reshape(len(side), trees, bits) * weight).sum(axis=2)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(side), t, np.int32)), pa.array(codes[:, t]), *part.columns],
                                                 names=["tree", "code", "node", "half", "norm"])
    return run


def _blocks(block: int, k: int):
    """Rows sorted by (tree, code) -> nearest within consecutive blocks of a tree."""
    def nearest(nodes: np.ndarray, x: np.ndarray, norm: np.ndarray) -> pa.RecordBatch:
        s = (x @ x.T) * norm[None, :]
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(nodes) - 1)
        if m < 1:
            return _fresh(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        rows = np.repeat(np.arange(len(nodes)), m)
        score = s[rows, top.ravel()] * norm[rows]
        return _fresh(nodes[rows], nodes[top.ravel()], score)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, None
        held: tuple | None = None
        for part in parts:
            trees = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(trees)) + 1).tolist(), len(trees)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if trees[a] != now:
                    if held is not None and len(held[0]):
                        yield nearest(*_with(before, held, block))
                    now, before, held = trees[a], None, None
                rows = part.slice(a, b - a)
                new = (rows.column(2).to_numpy(), _matrix(rows.column(3), "<f2").astype(np.float32), rows.column(4).to_numpy())
                held = new if held is None else tuple(np.concatenate(c) for c in zip(held, new, strict=True))
                while len(held[0]) >= block:
                    before = tuple(c[:block] for c in held)
                    held = tuple(c[block:] for c in held)
                    yield nearest(*before)
        if held is not None and len(held[0]):
            yield nearest(*_with(before, held, block))

    def _with(before: tuple | None, rest: tuple, block: int) -> tuple:
        """The last rows of a tree, filled up to a block with those before them."""
        if before is None:
            return rest
        return tuple(np.concatenate((b[len(r):], r)) for b, r in zip(before, rest, strict=True))

    return run


def _pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> (centre, member, fresh) both ways."""
    for part in parts:
        u, v, _, fresh = (c.to_numpy(zero_copy_only=False) for c in part.columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((u, v), (v, u), (fresh, fresh))], names=["centre", "member", "fresh"])


def _meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(group, node, half, norm, worst, fresh)`` sorted by group -> edges between a group's members, one of them fresh, that beat a node's worst."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run(table: pa.Table) -> pa.RecordBatch:
        group = table.column(0).to_numpy()
        nodes, norm, worst, fresh = (table.column(c).to_numpy() for c in (1, 3, 4, 5))
        x = _matrix(table.column(2).combine_chunks(), "<f2").astype(np.float32) * norm[:, None]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        out: list[tuple] = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b - a < 2:
                continue
            s = x[a:b] @ x[a:b].T
            i, j = np.nonzero((s > worst[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]))
            other = nodes[a + i] != nodes[a + j]
            i, j = i[other], j[other]
            out.append((nodes[a + i], nodes[a + j], s[i, j]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        return _fresh(*cols)

    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        size += part.num_rows
        group = part.column(0).to_numpy()
        if size >= 1 << 15 and group[0] != group[-1]:
            cut = int(np.searchsorted(group, group[-1]))
            yield run(pa.Table.from_batches([*held[:-1], part.slice(0, cut)]))
            held, size = [part.slice(cut)], part.num_rows - cut
    if held:
        yield run(pa.Table.from_batches(held))


class Index:
    """Distinct vectors, which ids have them, and the neighbour graph."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, halves: DataFrame, ids: DataFrame, members: DataFrame, graph: DataFrame, count: int) -> None:
        self.scratch, self.nodes, self.halves, self.ids, self.members, self.graph, self.count = scratch, nodes, halves, ids, members, graph, count


def valid_vectors(scratch: Scratch, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, size, data`` (float64 bytes) of all rows that take part (see :func:`search`), written once."""
    ship_package(vectors.sparkSession)
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return scratch.save(rows.mapInArrow(_valid, "vec_id long, size int, data binary"), "valid")


def build(vectors: DataFrame, k: int = 20, graph_k: int = 24, trees: int = 16, delta: float = 0.001,
          seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Index of the rows of ``vectors`` of the commonest length (see :func:`search`); serves up to ``k`` results per query.

    The descent ends after a round that changes at most the share ``delta`` of the edges.
    """
    scratch = Scratch(vectors.sparkSession, "nn-descent")
    valid = valid_vectors(scratch, vectors, id_col, vector_col)
    sizes = valid.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return _build(scratch, valid, sizes["size"] if sizes else 0, k, graph_k, trees, delta, seed)


def _build(scratch: Scratch, valid: DataFrame, size: int, k: int, graph_k: int, trees: int, delta: float, seed: int = 7) -> Index:
    spark = valid.sparkSession
    rows = valid.filter(F.col("size") == size).select("vec_id", "data", F.xxhash64("data").alias("h"))
    # the least k + 1 ids of a vector are enough for any query's k results
    least = rows.groupBy("data").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = scratch.save(least.select("node", "data", "n"), "nodes")
    count, copies = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = nodes.filter("n > 1").select("node", "data", "n")
    alone = nodes.filter("n = 1").select("node", F.col("node").alias("vec_id"))
    ids = scratch.save(alone.unionByName(join_groups(rows, shared, "data", "n", copies).select("node", "vec_id").distinct()), "ids")
    turn = F.row_number().over(W.partitionBy("node").orderBy("vec_id"))
    members = ids.withColumn("turn", turn).filter(F.col("turn") <= k + 1).select("node", "vec_id")
    halves = scratch.save(nodes.select("node", "data").mapInArrow(_half, "node long, half binary, norm float"), "halves")

    sample = halves.orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).toArrow()
    x = _matrix(sample.column("half").combine_chunks(), "<f2").astype(np.float32)
    bits = max(1, min(40, int(np.ceil(np.log2(max(2, count)))) + 2))
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees * bits)).astype(np.float32)
    cuts = np.median(x @ planes, axis=0) if len(x) else np.zeros(trees * bits, np.float32)
    coded = halves.mapInArrow(_coded(planes, cuts, trees), "tree int, code long, node long, half binary, norm float")
    blocks = (coded.repartitionByRange(shuffle_partitions(spark), "tree", "code", "node").sortWithinPartitions("tree", "code", "node")
              .mapInArrow(_blocks(BLOCK, BLOCK_K), _EDGES_SQL))
    graph = scratch.save(_nearest(blocks, graph_k), "graph0")
    split = None
    for r in count_up(1):
        worst = graph.groupBy("node").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
            "node", F.when(F.col("n") >= graph_k, F.col("least")).otherwise(F.lit(float("-inf")).cast("float")).alias("worst"))
        told = halves.join(worst, "node", "left").select(F.col("node").alias("member"), "half", "norm", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        pairs = graph.mapInArrow(_pairs, "centre long, member long, fresh boolean")
        pairs = scratch.save(pairs.groupBy("centre", "member").agg(F.min("fresh").alias("fresh")), f"pairs{r}")
        centres = scratch.save(pairs.groupBy("centre").agg(F.count("*").alias("n"), F.max("fresh").alias("any")), f"centres{r}")
        # pairs of a split centre may never have met: none of its members counts as old from then on
        hubs = scratch.save(centres.filter(F.col("n") > MEET).select("centre"), f"hubs{r}")
        split = hubs if split is None else scratch.save(split.unionByName(hubs).distinct(), f"split{r}")
        busy = centres.join(split.withColumn("all", F.lit(True)), "centre", "left").filter("any or all").select("centre", "n", F.col("all").isNotNull().alias("all"))
        salt = F.pmod(F.xxhash64("member", F.lit(r)), F.ceil(F.col("n") / MEET))
        met = (pairs.join(busy, "centre").select("member", F.xxhash64("centre", salt).alias("group"), (F.col("fresh") | F.col("all")).alias("fresh"))
               .join(told, "member").select("group", F.col("member").alias("node"), "half", "norm", "worst", "fresh"))
        met = met.repartition("group").sortWithinPartitions("group").mapInArrow(_meet, _EDGES_SQL)
        graph = scratch.save(_nearest(graph.withColumn("fresh", F.lit(False)).unionByName(met), graph_k), f"graph{r}")
        scratch.drop(f"pairs{r}", f"centres{r}", f"graph{r - 1}")
        edges, changed = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if changed <= delta * edges:
            break
    return Index(scratch, nodes, halves, ids, members, graph, count)


# Search.  A request or answer carries ids and scores as packed arrays.
_CELL_SQL = "cell int, kind int, node long, half binary, norm float, ids binary"
_ROUTED = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("node", pa.int64()), ("half", pa.binary()), ("norm", pa.float32()), ("ids", pa.binary())])
_STATE = pa.schema([("query", pa.int64()), ("kind", pa.int32()), ("half", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary()),
                    ("open", pa.binary()), ("seen", pa.binary()), ("done", pa.binary())])
_STATE_SQL = "query long, kind int, half binary, ids binary, scores binary, open binary, seen binary, done binary"
#: Nodes that a search may enter by, besides the query's own.
ENTRIES, ENTER_BY = 512, 4


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by node -> ``(node, ids)``."""
    held_n, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(n)) + 1, [len(n)])).tolist()
        return pa.RecordBatch.from_arrays([pa.array(n[cuts[:-1]]), pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["node", "ids"])

    for part in parts:
        held_n, held_v = np.concatenate((held_n, part.column(0).to_numpy())), np.concatenate((held_v, part.column(1).to_numpy()))
        cut = int(np.searchsorted(held_n, held_n[-1])) if len(held_n) else 0
        if cut:
            yield out(held_n[:cut], held_v[:cut])
            held_n, held_v = held_n[cut:], held_v[cut:]
    if len(held_n):
        yield out(held_n, held_v)


def _cell_of(nodes: np.ndarray, cells: int) -> np.ndarray:
    h = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(cells)).astype(np.int32)


def _celled(cells: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(_cell_of(part.column(0).to_numpy(), cells)), pa.array(np.zeros(n, np.int32)), *part.columns], schema=_ROUTED)
    return run


def _requests(query: int, half: bytes | None, ids: np.ndarray, cells: int) -> list[tuple]:
    """One row per cell that has any of the ids."""
    cell = _cell_of(ids, cells)
    order = np.argsort(cell, kind="stable")
    cell, ids = cell[order], ids[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)])).tolist()
    return [(int(cell[a]), 1, query, half, 0.0, ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    if not rows:
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _ask_edges(cells: int):
    """States -> requests for the neighbours of their open nodes."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for query, open_ in zip(part.column("query").to_pylist(), part.column("open").to_pylist(), strict=True):
                out += _requests(query, None, np.frombuffer(open_, np.int64), cells)
            yield _rows(_ROUTED, out)
    return run


def _answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, kind): a cell's nodes, then requests.

    A request with a vector is answered with scores, one without with the
    neighbours of its nodes.
    """
    now, nodes, halves, norms, lists = None, [], [], [], []
    ready: tuple | None = None
    for part in parts:
        out: list[tuple] = []
        for cell, kind, node, half, norm, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if cell != now:
                now, nodes, halves, norms, lists, ready = cell, [], [], [], [], None
            if kind == 0:
                nodes.append(node)
                halves.append(half)
                norms.append(norm)
                lists.append(np.frombuffer(ids or b"", np.int64))
                continue
            if ready is None:
                own = np.array(nodes, np.int64)
                order = np.argsort(own)
                x = np.frombuffer(b"".join(halves), "<f2").reshape(len(own), -1).astype(np.float32) * np.array(norms, np.float32)[:, None] if nodes else None
                ready = (own[order], order, x)
            asked = np.frombuffer(ids, np.int64)
            if not nodes:
                continue
            at = np.minimum(np.searchsorted(ready[0], asked), len(nodes) - 1)
            there = ready[0][at] == asked
            at, asked = ready[1][at[there]], asked[there]
            if half is None:
                found = np.unique(np.concatenate([lists[i] for i in at])) if len(at) else asked
                out.append((node, 1, None, found.tobytes(), None, None, None, None))
            else:
                score = ready[2][at] @ np.frombuffer(half, "<f2").astype(np.float32)
                out.append((node, 2, None, asked.tobytes(), score.astype(np.float32).tobytes(), None, None, None))
        yield _rows(_STATE, out)


def _ask_scores(cells: int):
    """Rows sorted by (query, kind): a state, then neighbours -> requests for the scores of those not seen."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, found = None, []

        def ask() -> list[tuple]:
            if state is None or not found:
                return []
            new = np.setdiff1d(np.concatenate(found), np.frombuffer(state[3], np.int64))
            return _requests(state[0], state[1], new, cells)

        for part in parts:
            out: list[tuple] = []
            for query, kind, half, ids, seen in zip(*(part.column(c).to_pylist() for c in ("query", "kind", "half", "ids", "seen")), strict=True):
                if kind == 0:
                    out += ask()
                    state, found = (query, half, None, seen), []
                elif state is not None and state[0] == query:
                    found.append(np.frombuffer(ids, np.int64))
            yield _rows(_ROUTED, out)
        yield _rows(_ROUTED, ask())
    return run


def _merge(beam: int, head: int):
    """Rows sorted by (query, kind): a state, then scores -> the next state."""
    def step(state: tuple, ids: list[np.ndarray], scores: list[np.ndarray]) -> tuple:
        query, half, old_ids, old_scores, open_, seen, done = state
        none = np.zeros(0, np.int64)
        done = np.union1d(np.frombuffer(done, np.int64), np.frombuffer(open_, np.int64))
        seen = np.union1d(np.frombuffer(seen, np.int64), np.concatenate([none, *ids]))
        every = np.concatenate([np.frombuffer(old_ids, np.int64), *ids])
        value = np.concatenate([np.frombuffer(old_scores, np.float32), *scores])
        order = np.lexsort((every, -value))[:beam]
        every, value = every[order], value[order]
        top = every[:head]
        return (query, 0, half, every.tobytes(), value.tobytes(), top[~np.isin(top, done)].tobytes(), seen.tobytes(), done.tobytes())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ids, scores = None, [], []
        names = ("query", "kind", "half", "ids", "scores", "open", "seen", "done")
        for part in parts:
            out: list[tuple] = []
            for query, kind, half, i, s, open_, seen, done in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if kind == 0:
                    if state is not None:
                        out.append(step(state, ids, scores))
                    state, ids, scores = (query, half, i, s, open_, seen, done), [], []
                elif state is not None and state[0] == query:
                    ids.append(np.frombuffer(i, np.int64))
                    scores.append(np.frombuffer(s, np.float32))
            yield _rows(_STATE, out)
        if state is not None:
            yield _rows(_STATE, [step(state, ids, scores)])

    return run


def _entered(nodes: np.ndarray, x: np.ndarray, beam: int):
    """Rows ``(query, half, norm, own)`` -> first states: the best entry nodes, and the query's own node if it has one."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for query, half, norm, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                q = np.frombuffer(half, "<f2").astype(np.float32)
                value = x @ q
                ids = nodes
                if own is not None:
                    others = nodes != own
                    ids, value = np.append(nodes[others], own), np.append(value[others], norm)
                order = np.lexsort((ids, -value))[:beam]
                enter = ids[order[:ENTER_BY]]
                if own is not None and own not in enter:
                    enter = np.append(enter, own)
                out.append((query, 0, half, ids[order].tobytes(), value[order].astype(np.float32).tobytes(), enter.tobytes(), np.sort(ids).tobytes(), b""))
            yield _rows(_STATE, out)
    return run


def _beam_pairs(most: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = [np.frombuffer(x, np.int64)[:most] for x in part.column(1).to_pylist()]
            query = np.repeat(part.column(0).to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))], names=["query", "near"])
    return run


def _exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(query, near, query data, near data)`` -> double-precision inner products."""
    for part in parts:
        if part.num_rows:
            score = np.einsum("ij,ij->i", _matrix(part.column(2), "<f8"), _matrix(part.column(3), "<f8"))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["query", "near", "score"])


def greedy_search(index: Index, queries: DataFrame, beam: int, head: int, degree: int) -> DataFrame:
    """``query, near, score``: the ``beam`` best nodes found for every query ``(query, data, own)``.

    ``data``: the vector as float64 bytes; ``own``: the node with the same
    vector, or null.  A round expands the unexpanded nodes among the best
    ``head`` of every beam over each node's ``degree`` nearest neighbours
    in either direction; the search ends when there are none.
    """
    scratch, spark = index.scratch, queries.sparkSession
    cells = max(1, -(-index.count // CELL_NODES))
    both = index.graph.unionByName(index.graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "score", "fresh"))
    lists = _nearest(both, degree).repartition("node").sortWithinPartitions("node").mapInArrow(_packed, "node long, ids binary")
    placed = scratch.save(index.halves.join(lists, "node", "left").select("node", "half", "norm", "ids").mapInArrow(_celled(cells), _CELL_SQL), "cells")
    sample = index.halves.orderBy(F.xxhash64("node")).limit(ENTRIES).toArrow()
    x = _matrix(sample.column("half").combine_chunks(), "<f2").astype(np.float32) * sample.column("norm").to_numpy()[:, None]
    asked = queries.select(F.col("query").alias("node"), "data").mapInArrow(_half, "node long, half binary, norm float")
    asked = asked.select(F.col("node").alias("query"), "half", "norm").join(queries.select("query", "own"), "query")
    state = scratch.save(asked.mapInArrow(_entered(sample.column("node").to_numpy(), x, beam), _STATE_SQL), "state0")
    ended = None

    def routed(requests: DataFrame) -> DataFrame:
        rows = requests.unionByName(placed)
        return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_answer, _STATE_SQL)

    def by_query(answers: DataFrame) -> DataFrame:
        return state.unionByName(answers).repartition("query").sortWithinPartitions("query", "kind")

    # a node is expanded once per query, so every search ends
    for r in count_up(1):
        near = routed(state.mapInArrow(_ask_edges(cells), _CELL_SQL))
        scores = routed(by_query(near).mapInArrow(_ask_scores(cells), _CELL_SQL))
        new = scratch.save(by_query(scores).mapInArrow(_merge(beam, head), _STATE_SQL), f"state{r}")
        done = new.filter(F.octet_length("open") == 0).select("query", "ids")
        ended = done if ended is None else ended.unionByName(done)
        state = new.filter(F.octet_length("open") > 0)
        if not state.limit(1).count():
            break
    pairs = ended.mapInArrow(_beam_pairs(beam), "query long, near long")
    pairs = pairs.join(index.nodes.select(F.col("node").alias("near"), F.col("data").alias("near_data")), "near")
    pairs = pairs.join(queries.select("query", "data"), "query").select("query", "near", "data", "near_data")
    return scratch.save(pairs.mapInArrow(_exact, "query long, near long, score double"), "found")


def search(vectors: DataFrame, k: int = 20, every: int = 20, graph_k: int = 24, trees: int = 16, delta: float = 0.001, beam: int = 96, head: int = 48,
           degree: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Candidates are all rows but the query's own id, nearest (largest inner
    product, double precision) first, ties to the smaller id.  Rows with a
    null id, and vectors that are null, zero, or hold null or non-finite
    components take no part.  An inner product needs equal lengths: vectors
    of each length have an index of their own.  Equal vectors are
    one node and come back as all their ids.  Rows repeated with id and
    vector count once; a repeated id with several vectors is a query with
    each and may be found with each.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(Scratch(spark, "nn-descent"), vectors, id_col, vector_col)
    sizes = [r[0] for r in valid.select("size").distinct().orderBy("size").collect()] or [0]  # one row per length of vector
    parts = [_search_index(_build(Scratch(spark, f"nn-descent-{size}"), valid, size, k, graph_k, trees, delta), k, every, beam, head, degree)
             for size in sizes]
    return reduce(DataFrame.unionByName, parts)


def _search_index(index: Index, k: int, every: int, beam: int, head: int, degree: int) -> DataFrame:
    asking = index.ids.filter(F.col("vec_id") % every == 0)
    own = index.nodes.join(asking.select("node").distinct(), "node", "left_semi")
    queries = index.scratch.save(own.select(F.col("node").alias("query"), "data", F.col("node").alias("own")), "queries")
    found = greedy_search(index, queries, beam, head, degree)
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = (found.join(index.members.withColumnRenamed("node", "near"), "near").withColumn("turn", F.row_number().over(best))
            .filter(F.col("turn") <= k + 1).select("query", "vec_id", "score"))
    asking = asking.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return (asking.join(near, "query").filter("query_id <> vec_id").withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
