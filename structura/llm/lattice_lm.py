"""Language-model scores from a subword lattice (operator 10).

A word is a path through the lattice of vocabulary pieces.  Unigram
weights of the pieces weight all its segmentations, and a log-space
forward recursion sums them to the word's marginal probability; a
document's is the product over its words and the end.  The file's scores
are the first weights; rounds of forward and backward sums over all
distinct words of the training documents re-estimate them by expected
counts (the pieces stay as they are).  A word seen ``c`` times among ``N``
training tokens of ``V`` kinds is an edge over its whole lattice, too: its
marginal is ``(c + V * lattice) / (N + V)``, where ``lattice`` sums the
segmentations into pieces, so the pieces share out what unseen words get.

Each map task cuts its documents into chunks and gives every distinct
word of a chunk a local number: a word then moves once per chunk, not
once per occurrence.  Words meet their corpus counts in one shuffle and
are written in that order; the rounds and the marginals read them there,
and the values go back to the chunks, whose documents are kept as lists
of local numbers.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import pieces
from .common import Scratch, crc_mod, ship_package, utf8_bytes
from .lattice_batch import BatchLattice
from .lattice_fit import Expectation, reweighted

#: A chunk ends after this many distinct words, or this many bytes of text.
CHUNK_WORDS, CHUNK_BYTES = 200_000, 32 << 20
#: Marginals are worked out for this many distinct words at once, or for those of this many rows.
BULK_WORDS, BULK_ROWS = 20_000, 400_000

_CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                     ("ids", pa.binary()), ("tfs", pa.binary()), ("local_id", pa.int32()), ("word", pa.binary()), ("c", pa.int64())])
_CHUNKS_SQL = ("chunk long, doc_id long, held_out boolean, n_tokens long, ids binary, tfs binary, "
               "local_id int, word binary, c long")
_UNITS = pa.schema([("place", pa.int32()), ("units", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64()), ("lattice_score", pa.float64())])


class _Chunk:
    """Documents as (local word numbers, frequencies), and the words' training counts.

    The end of a document is the empty word.
    """

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.train = np.zeros(1 << 12, np.int64)
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, held_out: bool, text: bytes) -> None:
        tf = Counter(text.lower().split())
        tf[b""] = 1
        ids = np.fromiter(map(self.numbers.__getitem__, tf), np.int32, len(tf))
        n = np.fromiter(tf.values(), np.int32, len(tf))
        if not held_out:
            if len(self.numbers) > len(self.train):
                grown = np.zeros(2 * len(self.numbers), np.int64)
                grown[:len(self.train)] = self.train
                self.train = grown
            self.train[ids] += n
        self.docs.append((doc_id, held_out, int(n.sum(dtype=np.int64)), ids.tobytes(), n.tobytes()))
        self.size += len(text)

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.docs), 1024):
            cols = list(zip(*self.docs[at:at + 1024], strict=True))
            n = len(cols[0])
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()),
                                              pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary()), *none],
                                             schema=_CHUNKS)
        words, n = list(self.numbers), len(self.numbers)
        train = np.zeros(n, np.int64)
        train[:min(n, len(self.train))] = self.train[:n]
        for at in range(0, n, 1 << 15):
            part = words[at:at + (1 << 15)]
            m = len(part)
            none = [pa.nulls(m, f.type) for f in list(_CHUNKS)[1:6]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), *none, pa.array(np.arange(at, at + m, dtype=np.int32)),
                                              pa.array(part, pa.binary()), pa.array(train[at:at + m])], schema=_CHUNKS)


def _chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, now = TaskContext.get().partitionId() << 24, _Chunk()
    for part in parts:
        for doc_id, held_out, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8_bytes(part.column(2)), strict=True):
            now.add(doc_id, held_out, text)
            if len(now.numbers) >= CHUNK_WORDS or now.size >= CHUNK_BYTES:
                yield from now.rows(chunk)
                chunk, now = chunk + 1, _Chunk()
    if now.docs:
        yield from now.rows(chunk)


def _changes(words: pa.Array, last: bytes | None) -> np.ndarray:
    """Whether each word differs from the one before it; ``last`` is before the first."""
    changed = np.ones(len(words), bool)
    changed[0] = words[0].as_py() != last
    changed[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
    return changed


def _mark_first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with equal words together -> the same rows and whether they are their word's first."""
    last = None
    for part in parts:
        words = part.column(0)
        first = _changes(words, last) if len(words) else np.zeros(0, bool)
        last = words[-1].as_py() if len(words) else last
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first)], names=["word", "chunk", "local_id", "c", "first"])


def _token(word: bytes) -> str:
    return pieces.MARK + word.decode("utf-8", "replace")


def _expected(lattice):
    """Rows ``(word, c)`` of distinct words -> units by place in the lattice; byte ``b`` has place ``-1 - b``."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for part in parts:
            found = found or Expectation(lattice.value)
            found.add([_token(w) for w in part.column(0).to_pylist()], part.column(1).to_numpy())
        if found is None:
            return
        places, spelled = np.flatnonzero(found.taken), np.flatnonzero(found.spelled)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([places, -1 - spelled]).astype(np.int32)),
                                          pa.array(np.concatenate([found.taken[places], found.spelled[spelled]]))], schema=_UNITS)
    return run


def fit(words: DataFrame, given: pieces.Vocabulary, ends: int, rounds: int) -> pieces.Vocabulary:
    """``given`` with weights re-estimated in ``rounds`` rounds over ``words`` (``word, c``: distinct words and their counts).

    Every round reads all words; tasks return sums per piece, and the
    driver gets one sum per piece of the vocabulary, whatever the data.
    """
    now = given
    for _ in range(rounds):
        lattice = BatchLattice(now)
        shared = words.sparkSession.sparkContext.broadcast(lattice)
        units = dict(words.mapInArrow(_expected(shared), "place int, units long").groupBy("place").agg(F.sum("units")).collect())
        shared.unpersist()
        now = reweighted(lattice, {p: n for p, n in units.items() if p >= 0}, {-1 - p: n for p, n in units.items() if p < 0}, ends, given)
    return now


def _marginals(lattice):
    """Rows ``(word, chunk, local_id, c)`` with equal words together -> ``(chunk, local_id, c, lattice)``.

    Words of several batches are worked out at once: a pass costs much the
    same for a few words as for thousands.
    """
    def values(held: list[pa.RecordBatch], place: list[np.ndarray], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        logps = word_logps(lattice.value, words)
        for part, at in zip(held, place, strict=True):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logps[at])], names=["chunk", "local_id", "c", "lattice"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, words, rows, size = [], [], [], 0, 0
        for part in parts:
            if not part.num_rows:
                continue
            column = part.column(0)
            changed = _changes(column, words[-1] if words else None)
            place.append(np.cumsum(changed) + (len(words) - 1))
            new = column.filter(pa.array(changed))
            words += new.to_pylist()
            held.append(part.drop_columns(["word"]))
            rows, size = rows + part.num_rows, size + new.nbytes
            if len(words) >= BULK_WORDS or rows >= BULK_ROWS or size >= CHUNK_BYTES:
                yield from values(held, place, words)
                held, place, words, rows, size = [], [], [], 0, 0
        if held:
            yield from values(held, place, words)
    return run


def word_logps(lattice: BatchLattice, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's lattice probability; the empty word is the end of the text.

    Given that a word begins or the text ends.  A word goes on until the
    next piece begins a word or is the end; that piece's share follows the
    word and precedes the next one, so a word has its pieces' product and
    the end, which nothing follows, its share of the beginnings.  Over all
    words and the end this sums to at most one.
    """
    values = lattice.marginals([_token(w) for w in words])
    values[[k for k, w in enumerate(words) if not w]] = lattice.v.end_logp - lattice.v.start_logp
    return values


def _score(n: int, kinds: int):
    """Rows sorted by (chunk, values before documents) -> scored documents."""
    log10_total = math.log10(n + max(kinds, 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, cs, lats = None, [], [], []
        table: tuple[np.ndarray, ...] | None = None
        for part in parts:
            chunk = part.column("chunk").to_numpy()
            is_doc = part.column("ids").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(chunk) != 0) | np.diff(is_doc)) + 1).tolist(), len(chunk)]
            done: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if chunk[a] != now:
                    now, ids, cs, lats, table = chunk[a], [], [], [], None
                if not is_doc[a]:
                    ids.append(part.column("local_id")[a:b].to_numpy())
                    cs.append(part.column("c")[a:b].to_numpy())
                    lats.append(part.column("lattice")[a:b].to_numpy())
                    continue
                if table is None:
                    table = _logs(np.concatenate(ids), np.concatenate(cs), np.concatenate(lats), n, kinds, log10_total)
                    ids, cs, lats = [], [], []
                known, base, model, lattice = table
                rows = part.slice(a, b - a)
                for doc_id, held_out, tokens, own, tf in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "held_out", "n_tokens", "ids", "tfs")), strict=True):
                    own, tf = np.frombuffer(own, np.int32), np.frombuffer(tf, np.int32)
                    done.append((doc_id, held_out, tokens, int(tf[known[own]].sum(dtype=np.int64)),
                                 float(tf @ base[own]), float(tf @ model[own]), float(tf @ lattice[own])))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SCORES, strict=True)], schema=_SCORES)
    return run


def _logs(ids: np.ndarray, c: np.ndarray, lattice: np.ndarray, n: int, kinds: int, log10_total: float) -> tuple[np.ndarray, ...]:
    """By local number: known, and log10 of the base, the model's and the lattice's probability."""
    order = np.argsort(ids)
    c, lattice = c[order], lattice[order]
    base = np.log10((c + 0.5) / (n + 0.5 * (kinds + 1)))
    with np.errstate(divide="ignore"):
        seen = np.log(c.astype(np.float64))
    model = np.logaddexp(seen, math.log(max(kinds, 1)) + lattice) / math.log(10) - log10_total
    return c > 0, base, model, lattice / math.log(10)


def score_documents(docs: DataFrame, vocabulary_path: str = pieces.VOCABULARY, folds: int = 5, held_out_fold: int = 1,
                    id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score`` per row of ``docs``.

    A-Z are lower-cased; tokens are the words (runs of non-white-space) and
    one end.  Rows whose CRC-32 of the id (as text) leaves ``held_out_fold``
    modulo ``folds`` are held out of the counts.  ``base_score``: add-half
    unigram; ``score``: the model above; ``lattice_score``: pieces alone,
    without edges for whole words; all log10 of the whole text's
    probability.  ``rounds``: how often the weights are re-estimated; with
    0 they are the file's.  A null text counts
    as empty (only the end); a null id as the id '' in the fold and stays
    null.  Repeated rows count each and are returned each.  With no
    training rows the counts are zero.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "lattice-lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, folds) == held_out_fold).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    chunks = scratch.save(rows.mapInArrow(_chunks, _CHUNKS_SQL), "chunks", compression="zstd")
    words = chunks.filter("word is not null").select("word", "chunk", "local_id", F.sum("c").over(W.partitionBy("word")).alias("c"))
    words = scratch.save(words.mapInArrow(_mark_first, "word binary, chunk long, local_id int, c long, first boolean"), "words", compression="zstd")
    # the rounds read distinct words, many times fewer than there are rows
    distinct = scratch.save(words.filter("first and c > 0").select("word", "c"), "distinct", compression="zstd")
    is_end = F.length("word") == 0
    n, kinds, ends = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0))).first()
    fitted = fit(distinct.filter(~is_end), pieces.load(vocabulary_path), ends, rounds)
    lattice = spark.sparkContext.broadcast(BatchLattice(fitted))
    values = words.select("word", "chunk", "local_id", "c").mapInArrow(_marginals(lattice), "chunk long, local_id int, c long, lattice double")
    texts = chunks.filter("ids is not null").select("chunk", "doc_id", "held_out", "n_tokens", "ids", "tfs")
    both = texts.unionByName(values, allowMissingColumns=True)
    both = both.repartition("chunk").sortWithinPartitions("chunk", F.col("ids").isNotNull())
    scored = both.mapInArrow(_score(n, kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, lattice_score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                         "base_score", "score", "lattice_score")
