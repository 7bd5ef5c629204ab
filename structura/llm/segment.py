"""Piece encoding and decoding with N-best segmentations (operator 2).

Encoding: the text's words, each with the word mark before it, are cut
into the pieces of the best total score.  N-best: forward Viterbi scores
of all prefixes are exact heuristics for an A* search that runs backward
over the piece lattice, so complete segmentations come out in order of
their score.  A document's N best differ from its best only in the words
whose second-best segmentation loses least; A* runs for those.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .lattice_batch import BatchLattice
from .common import ship_package, utf8_bytes

#: Distinct words that a task remembers.
CACHE_WORDS = 400_000
#: Bytes of text whose new words are worked out at once.
LEARN_BYTES = 4 << 20

_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()),
                  ("nbest_scores", pa.list_(pa.float64())), ("nbest_crc32", pa.list_(pa.int64()))])
_RANKED = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int32()))])
#: Ids in one batch of written segmentations.
OUT_IDS = 4 << 20


def forward(v: pieces.Vocabulary, token: str) -> tuple[list[list[tuple[int, float]]], list[float]]:
    """The lattice's edges by end, and the best score of every prefix."""
    edges = v.edges(token)
    alpha = [0.0] * (len(token) + 1)
    for j in range(1, len(token) + 1):
        alpha[j] = max(alpha[i] + p for i, p in edges[j])
    return edges, alpha


def nbest(v: pieces.Vocabulary, token: str, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """Up to ``n`` best segmentations as (score, piece spans), best first.

    Scores that agree to six decimals are ties; of tied partial paths the
    one that is nearest to the start goes first, so equal-scored ways are
    followed one by one and not all at once.
    """
    edges, alpha = forward(v, token)
    end = len(token)
    heap: list[tuple] = [(-round(alpha[end], 6), end, 0, 0.0, None)]
    out, made = [], 0
    while heap and len(out) < n:
        _, at, _, tail, spans = heapq.heappop(heap)
        if at == 0:
            found = []
            while spans is not None:
                found.append(spans[0])
                spans = spans[1]
            out.append((tail, found))
            continue
        for i, p in edges[at]:
            made += 1
            heapq.heappush(heap, (-round(alpha[i] + p + tail, 6), i, -made, p + tail, ((i, at), spans)))
    return sorted(out, key=lambda x: -x[0])


def _ids(v: pieces.Vocabulary, token: str, spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for i, j in spans:
        known = v.ids.get(token[i:j]) if not (i and token[i] == pieces.MARK) else None
        if known is None:
            out += [v.byte_ids[b] for b in token[i:j].encode("utf-8", "surrogatepass")]
        else:
            out.append(known)
    return out


def two_best(v: pieces.Vocabulary, token: str) -> tuple[float, float, list[tuple[int, int]]]:
    """Best and second-best score (-inf if there is one way only) and the best spans, by the forward pass alone."""
    steps, mark, n = v.steps.get, pieces.MARK, len(token)
    low = -math.inf
    first, second, back = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1)
    first[0] = 0.0
    for i in range(n):
        a, b = first[i], second[i]
        j, single = i + 1, False
        if not i or token[i] != mark:
            while j <= n:
                p = steps(token[i:j], 0.0)
                if p == 0.0:
                    break
                if p is not None:
                    if j == i + 1:
                        single = True
                    s = a + p
                    if s > first[j]:
                        second[j] = first[j]
                        first[j] = s
                        back[j] = i
                    elif s > second[j]:
                        second[j] = s
                    if b + p > second[j]:
                        second[j] = b + p
                j += 1
        if not single:
            p, j = v.spelled(token[i]), i + 1
            s = a + p
            if s > first[j]:
                second[j], first[j], back[j] = first[j], s, i
            elif s > second[j]:
                second[j] = s
            if b + p > second[j]:
                second[j] = b + p
    spans, j = [], n
    while j:
        spans.append((back[j], j))
        j = back[j]
    return first[n], second[n], spans[::-1]


def words(text: bytes) -> list[bytes]:
    return text.split()


class Codec:
    """Encodes and decodes texts with one vocabulary; remembers a bounded number of words."""

    def __init__(self, vocabulary: pieces.Vocabulary) -> None:
        self.v, self.lattice = vocabulary, BatchLattice(vocabulary)
        self.names = [n.replace(pieces.MARK, " ", 1).encode() if n.startswith(pieces.MARK) else n.encode() for n in vocabulary.names]
        for b, i in enumerate(vocabulary.byte_ids):
            self.names[i] = bytes([b])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[bytes] = []  # little-endian int32
        self.best, self.loss = np.zeros(0), np.zeros(0)  # best score, and by how much the second best is behind
        self.more: dict[tuple[bytes, int], list[tuple[float, bytes]]] = {}

    def learn(self, some: Iterable[bytes]) -> None:
        """Work out the forward passes of the words that are new, all at once."""
        number = self.number
        new = [w for w in dict.fromkeys(some) if w not in number]
        if not new:
            return
        tokens = [_token(w) for w in new]
        ids: list[bytes | None] = [None] * len(new)
        best, second = np.empty(len(new)), np.empty(len(new))
        groups, rest = self.lattice.groups(tokens)
        for places, chars in groups:
            best[places], second[places], back, via = self.lattice.two_best(chars)
            for k, found in zip(places.tolist(), self.lattice.best_ids(back, via), strict=True):
                if found is None:
                    rest.append(k)
                else:
                    ids[k] = found.tobytes()
        for k in rest:
            best[k], second[k], spans = two_best(self.v, tokens[k])
            ids[k] = array("i", _ids(self.v, tokens[k], spans)).tobytes()
        number.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.ids += ids
        self.best, self.loss = np.append(self.best, best), np.append(self.loss, best - second)

    def places(self, text: bytes) -> np.ndarray:
        """The numbers of the text's words, learnt or learnt now."""
        some = words(text)
        self.learn(some)
        return np.fromiter(map(self.number.__getitem__, some), np.int64, len(some))

    def encode(self, text: bytes) -> bytes:
        """Ids of the best segmentation as little-endian int32."""
        return b"".join(map(self.ids.__getitem__, self.places(text).tolist()))

    def decode(self, ids: bytes) -> bytes:
        """The words that the ids spell, joined by one space."""
        return b"".join(map(self.names.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:]

    def ways(self, word: bytes, n: int) -> list[tuple[float, bytes]]:
        """The word's ``n`` best segmentations as (loss to the best, ids), the forward pass's one first."""
        known = self.more.get((word, n))
        if known is None:
            token, first = _token(word), self.ids[self.number[word]]
            found = nbest(self.v, token, n)
            others = [(max(0.0, found[0][0] - s), array("i", _ids(self.v, token, spans)).tobytes()) for s, spans in found]
            # of tied best ways A* may meet another one first, or n others
            others = [x for x in others if x[1] != first][:n - 1]
            known = self.more[(word, n)] = [(0.0, first), *others]
        return known

    def nbest(self, text: bytes, n: int) -> list[tuple[float, bytes]]:
        """The document's ``n`` best segmentations as (score, ids as little-endian int32), best first (fewer if there are fewer)."""
        places, some = self.places(text), words(text)
        total, behind = float(self.best[places].sum()), self.loss[places]
        # only the n - 1 places with the least second-best losses can differ in one of the n best
        least = np.argpartition(behind, n - 2)[:n - 1] if len(behind) >= n > 1 else np.arange(len(behind) if n > 1 else 0)
        best: list[tuple[float, tuple]] = [(0.0, ())]  # loss, and (place, way) where the way is not the first
        for k in sorted(least.tolist()):
            if behind[k] < math.inf:
                ways = self.ways(some[k], n)
                best = heapq.nsmallest(n, ((a + loss, (*taken, (k, w)) if w else taken) for a, taken in best for w, (loss, _) in enumerate(ways)))
        parts = list(map(self.ids.__getitem__, places.tolist()))
        out = []
        for loss, taken in best:
            for k, w in taken:
                parts[k] = self.more[(some[k], n)][w][1]
            out.append((total - loss, b"".join(parts)))
            for k, _ in taken:
                parts[k] = self.ids[places[k]]
        return out

    def scores(self, text: bytes, n: int) -> list[float]:
        """Scores of the document's ``n`` best segmentations, best first."""
        return [s for s, _ in self.nbest(text, n)]


def _token(word: bytes) -> str:
    return pieces.MARK + word.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary_path: str = pieces.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int): the best segmentation of every text; a null text has no ids."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(pieces.load(vocabulary_path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for part in parts:
            ids = []
            for text in _learnt(codec, utf8_bytes(part.column(1))):
                ids.append(np.frombuffer(codec.encode(text), "<i4"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def nbest_documents(docs: DataFrame, n: int = 4, vocabulary_path: str = pieces.VOCABULARY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, rank, score, ids``: the ``n`` best segmentations of every text, best first (rank from 1; fewer if there are fewer).

    ``score``: natural log; ``ids``: array of int, which ``decode_documents``
    turns back to the text's words.  Ties are ordered by the words that
    differ.  Null and empty texts have one segmentation without ids, of
    score 0.  Null ids stay; repeated rows are returned each; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(pieces.load(vocabulary_path))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RANKED, strict=True)], schema=_RANKED)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        rows: list[tuple] = []
        size = 0
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), _learnt(codec, utf8_bytes(part.column(1))), strict=True):
                for rank, (score, ids) in enumerate(codec.nbest(text, n), 1):
                    rows.append((doc_id, rank, score, np.frombuffer(ids, "<i4")))
                    size += len(ids) // 4
                    if size >= OUT_IDS:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, rank int, score double, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary_path: str = pieces.VOCABULARY) -> DataFrame:
    """``doc_id, text``: the words of ``encoded`` (``doc_id, ids``) joined by one space; null ids give the empty text."""
    spark = encoded.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(pieces.load(vocabulary_path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for part in parts:
            texts = [codec.decode(np.array(ids or [], "<i4").tobytes()).decode("utf-8", "replace") for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _bounded(codec: Codec) -> None:
    if len(codec.ids) + len(codec.more) > CACHE_WORDS:
        codec.clear()


def _learnt(codec: Codec, texts: list[bytes]) -> Iterator[bytes]:
    """The texts, after the words of some megabytes of them have been learnt together."""
    at = 0
    while at < len(texts):
        _bounded(codec)
        end, size = at, 0
        while end < len(texts) and size < LEARN_BYTES:
            size += len(texts[end])
            end += 1
        codec.learn(w for t in texts[at:end] for w in words(t))
        yield from texts[at:end]
        at = end


def segment_documents(docs: DataFrame, n: int = 4, vocabulary_path: str = pieces.VOCABULARY, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, round_trip, nbest_scores, nbest_crc32`` for every row of ``docs``: digests of ``nbest_documents``.

    ``ids_crc32``: CRC-32 of the best segmentation's ids as little-endian
    int32; ``round_trip``: decoding those ids gives the text's words joined
    by one space; ``nbest_scores``: natural-log scores of the document's
    ``n`` best segmentations, ``nbest_crc32`` the CRC-32 of the ids of each.
    Null and empty texts have no pieces and one segmentation of score 0.  Null ids stay; repeated rows are returned
    each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(pieces.load(vocabulary_path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for part in parts:
            sizes, crcs, trips, scores = [], [], [], []
            for text in _learnt(codec, utf8_bytes(part.column(1))):
                found = codec.nbest(text, n)
                ids = found[0][1]
                scores.append([s for s, _ in found])
                crcs.append([zlib.crc32(x) for _, x in found])
                sizes.append(len(ids) // 4)
                trips.append(codec.decode(ids) == b" ".join(words(text)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([c[0] for c in crcs], pa.int64()), pa.array(trips),
                                              pa.array(scores, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64()))], schema=_OUT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, nbest_scores array<double>, nbest_crc32 array<long>")
