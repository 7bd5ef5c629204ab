"""Quality scores from naive Bayes support vectors in numpy (operator 12).

A text is the set of its hashed n-grams: of words (one and two) and of word
shapes (one to three).  A shape keeps the classes of a word's characters,
each run once, and says whether the word repeats the one before, so texts
of unseen words still share n-grams.  An n-gram's indicator is scaled by
the log ratio of its smoothed counts in the two classes, and a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate
descent.  Rows that the fit did not see set the threshold, and the score is
a logistic of the margin shifted so that the threshold is ``THRESHOLD``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, ship_package, utf8_bytes

THRESHOLD = 0.3
BUCKETS = 1 << 18
#: Training sample: labelled rows of each class at most, and bytes of one text at most.
TRAIN_ROWS, TRAIN_BYTES = 5_000, 1 << 15
#: N-grams in fewer training rows than this carry no weight.
LEAST_ROWS = 3
#: A task forgets its words beyond this number or these bytes; a text is read in steps of so many bytes.
CACHE_WORDS, CACHE_BYTES, STEP_BYTES = 300_000, 32 << 20, 1 << 20

_SPACE = b" \t\n\r\x0b\x0c"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KINDS = {name: np.uint64(k * 0x2545F4914F6CDD1D % (1 << 64)) for k, name in enumerate(("word", "words", "shape", "shapes", "three shapes"), 1)}
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """Character classes (``A``, ``a`` for small and non-ASCII letters, ``0``, others as they are), each run once, eight at most."""
    out = bytearray()
    for c in word.translate(_CLASS):
        if not out or out[-1] != c:
            out.append(c)
            if len(out) == 8:
                break
    return bytes(out)


class Words(dict):
    """Word -> number, in order of first use, with hashes of the ASCII-lower-cased word and of its shape."""

    def __init__(self) -> None:
        super().__init__()
        self._hashes, self._new, self.size = np.zeros((0, 2), np.uint64), [], 0

    def __missing__(self, word: bytes) -> int:
        low = word.lower()
        self._new.append((zlib.crc32(low) | zlib.crc32(low, 1) << 32, zlib.crc32(shape(word))))
        self.size += len(word)
        n = self[word] = len(self)
        return n

    @property
    def hashes(self) -> np.ndarray:
        if self._new:
            self._hashes = np.concatenate((self._hashes, np.array(self._new, np.uint64)))
            self._new = []
        return self._hashes

    def forget_if_full(self) -> None:
        if len(self) > CACHE_WORDS or self.size > CACHE_BYTES:
            self.clear()
            self.__init__()


def _slots(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(29)
    return ((x * _MIX) >> np.uint64(46)).astype(np.int32)  # the top 18 bits


def ngrams(words: Words, text: bytes) -> np.ndarray:
    """Distinct buckets of a whole text's n-grams, in order; a long text is read in steps, cut at white space."""
    words.forget_if_full()
    if len(text) <= STEP_BYTES:
        return np.unique(_step(words, [], text.split()))
    seen, tail, at = np.zeros(BUCKETS, bool), [], 0
    while at < len(text):
        end = min(at + STEP_BYTES, len(text))
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        parts = text[at:end].split()
        seen[_step(words, tail, parts)] = True
        tail, at = (tail + parts)[-3:], end
        words.forget_if_full()
    return np.flatnonzero(seen).astype(np.int32)


def _step(words: Words, tail: list[bytes], parts: list[bytes]) -> np.ndarray:
    """Buckets of the n-grams that end in ``parts``; ``tail`` has up to three words before them."""
    if not parts:
        return np.zeros(0, np.int32)
    t, every = len(tail), tail + parts
    numbers = np.fromiter(map(words.__getitem__, every), np.int64, len(every))
    hashes = words.hashes[numbers]
    w, s = hashes[:, 0], hashes[:, 1].copy()
    s[1:][w[1:] == w[:-1]] += np.uint64(1 << 40)  # repeats the word before
    k = np.uint64(31)
    return _slots(np.concatenate((
        w[t:] ^ _KINDS["word"], (w[:-1] * k + w[1:])[max(0, t - 1):] ^ _KINDS["words"], s[t:] ^ _KINDS["shape"],
        (s[:-1] * k + s[1:])[max(0, t - 1):] ^ _KINDS["shapes"], ((s[:-2] * k + s[1:-1]) * k + s[2:])[max(0, t - 2):] ^ _KINDS["three shapes"])))


@dataclass
class Model:
    """Weight of every n-gram, offset, and the margin at the threshold and slope of the score."""

    weights: np.ndarray
    offset: float = 0.0
    cut: float = 0.0
    slope: float = 1.0

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum(dtype=np.float64)) + self.offset

    def score(self, margins: np.ndarray) -> np.ndarray:
        return _sigmoid((margins - self.cut) * self.slope + np.log(THRESHOLD / (1 - THRESHOLD)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed shares of rows with label 1 and 0 that have an n-gram; 0 for n-grams of few rows."""
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for row, y in zip(rows, labels, strict=True):
        counts[int(y)][row] += 1
    n = [float((labels == y).sum()) for y in (0, 1)]
    ratio = np.log((counts[1] + smoothing) / (n[1] + 2 * smoothing)) - np.log((counts[0] + smoothing) / (n[0] + 2 * smoothing))
    return np.where(counts[0] + counts[1] >= LEAST_ROWS, ratio, 0.0)


def hinge_descent(rows: list[np.ndarray], values: np.ndarray, labels: np.ndarray, costs: np.ndarray, epochs: int = 40, tolerance: float = 0.01,
                  seed: int = 1) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, offset and dual variables of the L2-regularised hinge-loss model, by dual coordinate descent.

    Row i has the feature ``values[j]`` for each j in ``rows[i]``, and a constant 1.
    """
    rng = np.random.default_rng(seed)
    sign = np.where(labels > 0, 1.0, -1.0)
    own = [values[r] for r in rows]
    square = np.array([x @ x for x in own]) + 1
    alpha, w, offset = np.zeros(len(rows)), np.zeros(len(values)), 0.0
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, x, y = rows[i], own[i], sign[i]
            slope = y * (w[r] @ x + offset) - 1
            old = alpha[i]
            new = min(max(old - slope / square[i], 0.0), costs[i])
            worst = max(worst, abs(new - old) * square[i])
            if new != old:
                alpha[i] = new
                w[r] += (new - old) * y * x
                offset += (new - old) * y
        if worst < tolerance:
            break
    return w, offset, alpha


def fit(rows: list[np.ndarray], labels: np.ndarray, calibrate: np.ndarray, cost: float = 0.01) -> Model:
    """Train on the rows that ``calibrate`` doesn't mark, and set threshold and slope on those that it does (on all, if it marks one class only).

    Both classes weigh the same in sum.  With fewer than two classes to
    train on every score is ``THRESHOLD``.
    """
    train = np.flatnonzero(~calibrate)
    if len(set(labels[train].tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), slope=0.0)
    picked, y = [rows[i] for i in train], labels[train]
    ratios = log_count_ratios(picked, y)
    share = y.mean()
    w, offset, _ = hinge_descent(picked, ratios, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * cost)
    model = Model((w * ratios).astype(np.float32), offset)
    held = np.flatnonzero(calibrate)
    if len(set(labels[held].tolist())) < 2:
        held = np.arange(len(rows))
    margins = np.array([model.margin(rows[i]) for i in held])
    model.cut = _best_cut(margins, labels[held])
    model.slope = _slope(margins - model.cut, labels[held])
    return model


def _best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap at which the mean of both classes' recalls is best (of the first such gaps)."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], labels[order]
    kept = (y.sum() - np.cumsum(y)) / max(1, y.sum()) + np.cumsum(1 - y) / max(1, (1 - y).sum())
    kept[np.append(m[1:] == m[:-1], True)] = -1
    k = int(kept.argmax())
    return float((m[k] + m[min(k + 1, len(m) - 1)]) / 2)


def _slope(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> float:
    """Slope of a logistic through the threshold, by Newton steps on a weakly bounded likelihood."""
    scale = max(1e-9, float(np.abs(margins).mean()))
    x, a = margins / scale, 1.0
    shift = np.log(THRESHOLD / (1 - THRESHOLD))
    for _ in range(steps):
        p = _sigmoid(a * x + shift)
        grad, curve = float(((p - labels) * x).sum()) + 0.01 * a, float((p * (1 - p) * x * x).sum()) + 0.01
        a = min(max(a - grad / curve, 0.05), 50.0)
    return a / scale


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES, folds: int = 5, held_out_fold: int = 0,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows outside the held-out fold: the first ``rows`` of each class by hash of the id, texts up to ``text_bytes``.

    The sample is bounded by these two parameters whatever the data; its
    n-grams are found in tasks.  An id labelled twice has label 1 only if
    it always has; null ids and labels are left out; of several texts with
    one id the least is taken.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_out_fold))
             .groupBy(F.col(id_col).cast("long").alias("id")).agg((F.min(label_col) > 0).cast("int").alias("label")))
    order = F.xxhash64("id")
    sample = known.filter("label = 1").orderBy(order, "id").limit(rows).unionByName(known.filter("label = 0").orderBy(order, "id").limit(rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    found = (texts.join(F.broadcast(sample), "id").filter(F.octet_length("text") <= text_bytes)
             .groupBy("id", "label").agg(F.min("text").alias("text")).select(order.alias("h"), "id", "label", "text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in parts:
            grams = [ngrams(words, t).tobytes() for t in utf8_bytes(part.column(3))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(grams, pa.binary())], names=["h", "id", "label", "grams"])

    got = found.mapInArrow(run, "h long, id long, label int, grams binary").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    y, h = got.column("label").to_numpy().astype(np.int64), got.column("h").to_numpy()
    return fit([np.frombuffer(g, np.int32) for g in got.column("grams").to_pylist()], y, (h >> 20) % 4 == 0)


def score_documents(docs: DataFrame, model: Model, folds: int = 5, held_out_fold: int = 0, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, whole texts; ``predicted`` is 1 from ``THRESHOLD`` on.

    A null text counts as empty; an empty text has no n-grams and the score
    of the offset.  Null ids stay (they hash as '').  Repeated rows are
    scored each, ties score alike.  Other columns are ignored.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), held.value
        for part in parts:
            scores = own.score(np.array([own.margin(ngrams(words, t)) for t in utf8_bytes(part.column(2))]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, folds) == held_out_fold).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
