"""Best-fit packing of documents into training sequences (operator 5).

A bin is a sequence of ``capacity`` tokens.  Documents are dealt by a hash
of their id into packing groups of a bounded number of tokens, and each
group is packed best-fit, largest first.  Open bins stand ordered by
residual space and carry bitmaps: of the duplicate clusters inside, and of
the sources that are there at least once, twice, ... up to their limit.
The search starts at the tightest bin that has room and goes on to its
successors until a compatible one is found; none means a new bin.  Bins
with the same full sources share a list, so a search never walks over bins
that its source has filled, and equal items go on where the last one ended.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, ship_package, small_enough

#: Tokens and items that one packing group holds, as the target.
GROUP_TOKENS, GROUP_ITEMS = 400_000, 100_000
#: More equal rows than this are dealt over all groups.
EQUAL_ROWS = 1_000

_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("tokens", pa.int64()), ("bin_id", pa.int64()),
                  ("bin_offset", pa.int64()), ("bin_tokens", pa.int64())])


def pack(items: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for every item ``(size, source, cluster)``, given largest first; sizes from 1 to ``capacity``.

    No bin holds two items of one cluster (None: no cluster), or more than
    ``per_source`` of one source.
    """
    often = Counter(c for _, _, c in items if c is not None)
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in often.items() if n > 1)}
    source_bit: dict[object, int] = {}
    least = min((size for size, _, _ in items), default=1)
    # open bins by the set of sources that are full in them, each list ordered by (residual, bin)
    order: dict[int, list[tuple[int, int]]] = {}
    clusters: list[int] = []
    sources: list[list[int]] = []  # by bin: bitmap k has the sources that are there over k times
    out: list[tuple[int, int]] = []
    before, reached = None, (0, -1)
    for item in items:
        size, source, cluster = item
        own, bit = cluster_bit.get(cluster, 0), source_bit.setdefault(source, 1 << len(source_bit))
        # an equal item has just passed all bins before the one that it took, and they still conflict
        start = reached if own and item == before else (size, -1)
        best, where = None, 0
        for full, bins in order.items():
            if full & bit:
                continue
            at = bisect_left(bins, start)
            while at < len(bins) and clusters[bins[at][1]] & own:
                at += 1
            if at < len(bins) and (best is None or bins[at] < best):
                best, where = bins[at], full
        if best is not None:
            residual, b = best
            bins = order[where]
            del bins[bisect_left(bins, best)]
            if not bins:
                del order[where]
        else:
            residual, b = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        before, reached = item, best or (capacity + 1, 0)
        out.append((b, capacity - residual))
        clusters[b] |= own
        levels = sources[b]
        for k in range(per_source):
            if not levels[k] & bit:
                levels[k] |= bit
                break
        if residual - size >= least:  # else no item that is left fits in
            insort(order.setdefault(levels[-1], []), (residual - size, b))
    return out


def _run(capacity: int, per_source: int):
    def packed(group: int, rows: list[tuple]) -> pa.RecordBatch:
        """Rows ``(doc_id, tokens, source, cluster)`` of one group -> placements."""
        items = [((n - 1) % capacity + 1, source, cluster) for _, n, source, cluster in rows]
        order = sorted(range(len(rows)), key=lambda k: -items[k][0])
        places = pack([items[k] for k in order], capacity, per_source)
        bins = 1 + max((b for b, _ in places), default=-1)
        filled = [0] * bins
        for k, (b, _) in zip(order, places, strict=True):
            filled[b] += items[k][0]
        out, base = [], group << 32
        for k, (b, offset) in zip(order, places, strict=True):
            doc_id, n, _, _ = rows[k]
            whole = (n - 1) // capacity  # full bins of their own come first
            for piece in range(whole):
                out.append((doc_id, piece, piece * capacity, capacity, base + bins, 0, capacity))
                bins += 1
            out.append((doc_id, whole, whole * capacity, items[k][0], base + b, offset, filled[b]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part in parts:
            for group, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if group != now and held:
                    yield packed(now, held)
                    held = []
                now = group
                held.append(tuple(row))
        if held:
            yield packed(now, held)

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, per_source: int = 4, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", cluster_col: str | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``doc_id, piece, first_token, tokens, bin_id, bin_offset, bin_tokens``: where the pieces of every document lie.

    Tokens: the text's words and one end.  A document over ``capacity`` is
    cut into full pieces, each a bin of its own, and a rest that is packed;
    nothing is dropped.  No bin holds two documents of one duplicate cluster
    (``cluster_col``; by default documents with the same text) or more than
    ``per_source`` of one source (null is a source).  Null and empty texts
    have the end only and no cluster.  Repeated rows are packed each, as
    one cluster; ties go by cluster, source and id.  Other columns are ignored; an empty table
    gives no rows.
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be at least 1")
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "packing")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = (F.regexp_count(text, F.lit(WORD)) + 1).cast("long")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.xxhash64(text).cast("string")
    sizes = scratch.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("tokens"), F.col(source_col).cast("string").alias("source"),
                                     F.when(tokens > 1, cluster).alias("cluster")), "sizes")
    total, n = sizes.agg(F.sum((F.col("tokens") - 1) % capacity + 1), F.count("*")).first()
    groups = max(1, -(-(total or 0) // group_tokens), -(-n // GROUP_ITEMS))
    # rows are dealt by all their columns, so a repeated id can't pile up in one group; many equal rows are numbered and dealt one by one
    own = ["doc_id", "tokens", "cluster", "source"]
    many = scratch.save(sizes.groupBy(*own).agg(F.count("*").alias("equal")).filter(F.col("equal") > EQUAL_ROWS), "equal")
    heavy = many.count()
    salt = F.lit(0).cast("long")
    if heavy:  # fewer than one in EQUAL_ROWS of all rows
        sizes = sizes.withColumn("at", F.monotonically_increasing_id()).alias("s").join(
            small_enough(many, heavy, 200).alias("m"), reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in own]), "left"
        ).select("s.*", F.when(F.col("equal").isNotNull(), F.col("at")).otherwise(salt).alias("salt"))
        salt = F.col("salt")
    dealt = sizes.select(F.pmod(F.xxhash64(*own, salt), F.lit(groups)).alias("group"), "doc_id", "tokens", "source", "cluster")
    rows = dealt.repartition("group").sortWithinPartitions("group", F.desc("tokens"), "cluster", "source", "doc_id")
    return rows.mapInArrow(_run(capacity, per_source), "doc_id long, piece int, first_token long, tokens long, bin_id long, bin_offset long, bin_tokens long")


def sequences(docs: DataFrame, places: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: str = "</s>") -> DataFrame:
    """``bin_id, text``: the sequences themselves, words and ends joined by one space.

    ``doc_id`` must tell the rows of ``docs`` apart (a null id is one, too):
    rows that share an id can't be told apart in ``places``, and ValueError
    is raised for them rather than a text repeated or left out.
    """
    words = F.concat(F.expr(f"regexp_extract_all(coalesce(`{text_col}`, ''), '{WORD}', 0)".replace("\\", "\\\\")), F.array(F.lit(end)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), words.alias("words"))
    if texts.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError(f"{id_col} must tell the rows apart")
    j = places.join(texts, places["doc_id"].eqNullSafe(texts["id"]))
    cut = j.select("bin_id", "bin_offset", F.slice("words", (F.col("first_token") + 1).cast("int"), F.col("tokens").cast("int")).alias("part"))
    return cut.groupBy("bin_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bin_offset", "part"))), lambda x: x["part"])), " ").alias("text"))
