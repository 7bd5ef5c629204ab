"""Prefix trie over conversations by a van Emde Boas recursion (operator 11).

The sequences are cut at half depth, the halves at half of theirs, and so
on down to single turns.  All subproblems of one level are worked on in the
same Spark job, so a trie of depth d takes about log2(d) rounds, and no
task ever holds a whole conversation or a whole path.

*Blocks* (bottom up): every aligned run of 2^k turns gets a name from the
names of its halves.  *Cuts* (top down): the prefix that ends at a cut is
named by the prefix before its block and the block's name; upper tries and
lower forests go on in parallel.  Equal prefixes have equal names, and
nodes are a partial aggregate over names.  *Grafts* (bottom up, then down):
a block's total over a conversation's own nodes joins that of its lower
half, and what lies below a block is handed to its turns, so a node's
subtree total is a sum over the conversations that start with it.

Every pass halves or doubles the rows from level to level: the sum over all
levels is linear in the turns.  Names are SHA-256 digests, taken as exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ranked
from .common import Scratch, join_groups, ship_package, shuffle_partitions

#: Ids that one piece of a long member list holds.
PIECE_IDS = 4_096

_ROOT = hashlib.sha256(b"root").digest()
_PIECES = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])


def _name(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def original_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, place, item, chars``: the turns of every conversation, numbered from 0.

    Ordered by turn (null first), equal turns by the digest of role and
    text; by one distributed sort that never moves the texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                                _name(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary")).alias("item"),
                                F.length(text).cast("long").alias("chars"))
    return ranked(rows.filter("conv is not null"), ["conv"], ["turn", "item"], "place").select("conv", "place", "item", "chars")


def rebuilt_turns(turns: DataFrame, scratch: Scratch, stride: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """``(conv, d, item, chars, last)`` and ``(conv, len)``: conversations that begin with the first turns of their group's first one.

    Conversation c takes the first h turns of ``c - c mod stride``, h being
    its CRC-32 modulo ``heads``, then its own after its first h; d counts from 1.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    facts = sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(stride))).alias("base"))
    leads = sizes.select(F.col("conv").alias("base"), F.col("own").alias("n_base"))
    lead = F.least("h", F.coalesce("n_base", F.lit(0)))
    facts = scratch.save(facts.join(leads, "base", "left").withColumn("lead", lead)
                         .withColumn("len", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "facts")
    total = facts.agg(F.sum("own")).first()[0] or 0
    own = join_groups(turns, facts, "conv", "own", total).filter("place >= h").withColumn("d", F.expr("place - h + lead + 1"))
    tops = turns.filter(F.col("place") < heads).withColumnRenamed("conv", "base")
    headed = tops.join(facts.filter("lead > 0").select("conv", "base", "lead", "len"), "base").filter("place < lead").withColumn("d", F.col("place") + 1)
    cols = ["conv", "d", "item", "chars", (F.col("d") == F.col("len")).alias("last")]
    return scratch.save(own.select(*cols).unionByName(headed.select(*cols)), "rebuilt"), facts.select("conv", "len")


def named_prefixes(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, d, name, chars, last``: the name of every prefix of at least one turn of ``sequences`` (conv, d, item, chars, last)."""
    depth = sequences.agg(F.max("d")).first()[0] or 0
    levels = max(0, (depth - 1).bit_length())
    blocks = [sequences.select("conv", (F.col("d") - 1).alias("i"), F.col("item").alias("name"), "chars", "last")]
    for k in range(1, levels + 1):
        half = F.col("i") % 2
        upper, lower = F.max(F.when(half == 0, F.col("name"))), F.max(F.when(half == 1, F.col("name")))
        whole = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("j")).agg(
            upper.alias("upper"), lower.alias("lower"), F.max(F.when(half == 1, F.col("chars"))).alias("chars"), F.max(F.when(half == 1, F.col("last"))).alias("last"))
        whole = whole.filter("upper is not null and lower is not null")
        blocks.append(scratch.save(whole.select("conv", F.col("j").alias("i"), _name(F.lit(b"block"), "upper", "lower").alias("name"), "chars", "last"), f"blocks{k}"))
    cuts: list[DataFrame] = []
    for k in range(levels, -1, -1):
        # a prefix of odd * 2^k turns: the prefix before its last block of 2^k, which an earlier round has named, and the block
        ends = blocks[k].filter(F.col("i") % 2 == 0).withColumn("cut", F.col("i") * (1 << k))
        found = ends.filter("cut = 0").withColumn("before", F.lit(_ROOT))
        if cuts:
            above = cuts[0]
            for c in cuts[1:]:
                above = above.unionByName(c)
            above = above.select("conv", F.col("d").alias("cut"), F.col("name").alias("before"))
            found = found.unionByName(ends.filter("cut > 0").join(above, ["conv", "cut"]).select(found.columns))
        cut = found.select("conv", (F.col("cut") + (1 << k)).alias("d"), _name(F.lit(b"cut"), "before", "name").alias("name"), "chars", "last")
        cuts.append(scratch.save(cut, f"cuts{k}"))
    out = cuts[0]
    for c in cuts[1:]:
        out = out.unionByName(c)
    scratch.drop(*(f"blocks{k}" for k in range(1, levels + 1)))
    return out


def grafted(weights: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """``conv, d`` with each of ``columns`` summed over the places from ``d`` to the end of the conversation.

    ``weights``: one row for every place from 0 to the conversation's length.
    """
    depth = weights.agg(F.max("d")).first()[0] or 0
    levels = depth.bit_length()
    totals = [weights.select("conv", F.col("d").alias("i"), *columns)]
    for k in range(1, levels + 1):
        totals.append(scratch.save(totals[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(*(F.sum(c).alias(c) for c in columns)), f"totals{k}"))
    # what lies below a block: nothing below the largest; else what lies below the block around it, and for an upper half the lower half
    below = totals[levels].select("conv", "i", *(F.lit(0).cast("long").alias(c) for c in columns))
    for k in range(levels - 1, -1, -1):
        around = below.select("conv", F.col("i").alias("j"), *(F.col(c).alias(f"below_{c}") for c in columns))
        pairs = totals[k].withColumn("j", F.shiftright("i", 1)).groupBy("conv", "j").agg(
            F.max(F.col("i") % 2).alias("halves"),
            *(F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col(c))), F.lit(0)).alias(f"lower_{c}") for c in columns),
            *(F.max(F.when(F.col("i") % 2 == 0, F.col(c))).alias(f"upper_{c}") for c in columns))
        own = pairs.join(around, ["conv", "j"])
        leaf = k == 0  # at single places the place itself counts, too

        def half(which: int, own: DataFrame = own, leaf: bool = leaf) -> DataFrame:
            def value(c: str) -> Column:
                v = F.col(f"below_{c}") + (F.col(f"lower_{c}") if which == 0 or leaf else F.lit(0))
                return (v + F.col(f"upper_{c}") if which == 0 and leaf else v).alias(c)
            rows = own if which == 0 else own.filter("halves = 1")
            return rows.select("conv", (F.col("j") * 2 + which).alias("i"), *(value(c) for c in columns))

        below = scratch.save(half(0).unionByName(half(1)), f"below{k}")
    out = below if levels else totals[0]
    return out.withColumnRenamed("i", "d")


def end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """``name, ends_sha256`` from ``(name, conv)``: SHA-256 of the ids in ascending order, joined by commas.

    The ids are range-sorted and joined in pieces of bounded size; a digest
    then runs over the pieces of a name in order and holds one at a time.
    """
    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: bytes | None = None
        held: list[int] = []
        out: list[tuple[bytes, int, str]] = []
        for part in parts:
            for name, conv in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if held and (name != now or len(held) == PIECE_IDS):
                    out.append((now, held[0], ",".join(map(str, held))))
                    held = []
                now = name
                held.append(conv)
                if len(out) == 1_024:
                    yield _batch(_PIECES, out)
                    out = []
        if held:
            out.append((now, held[0], ",".join(map(str, held))))
        if out:
            yield _batch(_PIECES, out)

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for part in parts:
            out = []
            for name, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if name != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield _batch(_ENDS, out)
        if sha is not None:
            yield _batch(_ENDS, [(now, sha.hexdigest())])

    n = shuffle_partitions(ends.sparkSession)
    listed = scratch.save(ends.repartitionByRange(n, "name", "conv").sortWithinPartitions("name", "conv").mapInArrow(
        pieces, "name binary, first long, ids string"), "pieces")
    return listed.repartition(n, "name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends_sha256 string")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def prefix_trie(conversations: DataFrame, stride: int = 100, heads: int = 6, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see :func:`rebuilt_turns`), the empty one included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for
    the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (over the subtree: (members - 1) times the code points of a node's last
    text), ``ends_sha256`` (of the ids of members that end here).

    A null role or text counts as empty; a null turn comes first; turns of
    equal number are ordered by the SHA-256 of role and text, and repeated
    rows are turns of their own.  Rows without a conversation id belong to
    no conversation and are left out.  Negative ids belong to the group
    that starts at the next lower multiple of ``stride``.  Other columns
    are ignored.  An empty table gives no rows.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "trie")
    turns = original_turns(conversations, conv_col, turn_col, role_col, text_col)
    sequences, lengths = rebuilt_turns(turns, scratch, stride, heads)
    roots = lengths.select("conv", F.lit(0).cast("long").alias("d"), F.lit(_ROOT).alias("name"), F.lit(0).cast("long").alias("chars"), (F.col("len") == 0).alias("last"))
    rows = scratch.save(named_prefixes(sequences, scratch).unionByName(roots), "rows")
    nodes = scratch.save(rows.groupBy("name").agg(F.min("conv").alias("conv"), F.min("d").alias("d"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "nodes")
    above = rows.select("conv", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = scratch.save(nodes.join(above, ["conv", "d"], "left"), "placed")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = scratch.save(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "family")
    own = nodes.select("conv", "d", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    zero = F.lit(0).cast("long")
    weights = scratch.save(rows.select("conv", "d", "name").join(own, ["conv", "d"], "left").select(
        "conv", "d", "name", F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved")), "weights")
    sums = grafted(weights, ["leaves", "saved"], scratch)
    totals = weights.select("conv", "d", "name").join(sums, ["conv", "d"]).groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    digests = end_digests(rows.filter("last").select("name", "conv"), scratch)
    done = scratch.save(nodes.join(totals, "name").join(digests, "name", "left"), "done")
    parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    kids = done.filter("parent is not null")
    placed = join_groups(kids.withColumnRenamed("n_children", "own_children"), parents, "parent", "n_children", kids.count()).drop("n_children").withColumnRenamed("own_children", "n_children")
    placed = placed.unionByName(done.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return placed.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


#: The query in DuckDB's SQL, with lists as prefixes and every node against every other.
ORACLE = """
WITH c AS MATERIALIZED (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
           lambda crc, b: list_reduce(list_transform(range(8), lambda k: CAST(k AS BIGINT)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), s AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1 : c.h], c.own[c.h + 1 :]) AS seq
  FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100
), p AS MATERIALIZED (
  SELECT conv_id, len(seq) AS n, d, seq[1 : d] AS prefix FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM s)
), n AS MATERIALIZED (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY prefix, d
), k AS MATERIALIZED (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.d = n.d + 1 AND x.prefix[1 : n.d] = n.prefix) AS n_children
  FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.prefix = n.prefix[1 : n.d - 1]
)
SELECT k.conv_id, k.d AS depth, any_value(k.parent_conv_id) AS parent_conv_id, any_value(k.n_convs) AS n_convs, any_value(k.n_children) AS n_children,
       count(*) FILTER (x.n_children = 0) AS n_leaves,
       CAST(sum(CASE WHEN x.d > 0 THEN (x.n_convs - 1) * length(x.prefix[x.d].t) ELSE 0 END) AS BIGINT) AS saved_tokens, any_value(k.ends_sha256) AS ends_sha256
FROM k JOIN k AS x ON x.d >= k.d AND x.prefix[1 : k.d] = k.prefix GROUP BY k.conv_id, k.d
"""
