"""Toxicity scores from a convolutional text classifier in numpy (operator 8).

A word's embedding is the sum of three hashed rows: of the word, and of
its first four and six characters, so rare forms share what is learnt.
Filters of several widths run over the words; each filter's outputs are
max-pooled within segments of 64 words, and the text is described by the
mean of the segments' maxima and by the greatest of them.  A logistic
layer on top gives the raw score.  Training keeps only the arg-max
positions, so its backward pass is sparse.

Every labelled row outside the held-out fold counts, with its whole text.
Training goes in rounds: each task starts from the shared parameters, goes
a few times over its rows in small batches, and the tasks' changes are
averaged by a shuffle over slices of the parameters.  What reaches the
driver in a round is one model, whatever the data; what is shuffled is one
model for each task and round.

Thresholds are calibrated by language on all labelled rows (a quarter) that
training did not see, from counts by score.  The language is guessed from the text's own function words
(``lang`` is no input), and the score is shifted so that each language's
threshold lands on ``THRESHOLD``.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, ship_package, utf8_bytes

THRESHOLD = 0.7
SEGMENT = 64
BUCKETS, WIDTH, FILTERS = 1 << 16, 12, {1: 12, 2: 8, 3: 8}
#: Bytes of hashed rows (six a word) that a training task gets at least, training tasks at most (each then has more rows, which it streams).
PART_BYTES, MOST_PARTS = 24 << 20, 256
#: Rows and bytes that a training task mixes, and words of one batch; a longer text is a batch by itself.
BLOCK_ROWS, BLOCK_BYTES, BATCH_WORDS = 4_096, 16 << 20, 1 << 20
#: Visits that a training row gets; passes in between so that there are about so many visits in all.
VISITS, PASSES = 40_000, (8, 30)
#: Passes that a task makes before changes are averaged, and the bytes of hashed rows that it holds for them; with more it streams them, one pass a round.
ROUND_PASSES, HELD_BYTES = 4, 64 << 20
#: Hashed rows in a slice of the parameters.
SLICE = 1_024
#: Calibration counts scores in steps of log odds of one over this.
STEPS = 256
#: Share of the words that a training visit leaves out.
LEFT_OUT = 0.5
#: Distinct words that a task remembers, and segments that it convolves at once.
CACHE_WORDS, STEP_SEGMENTS = 400_000, 1_024

#: Frequent function words by language; the language with most of them is the guess, the first on ties.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as be this are have not or".split(),
    "de": "der die und das den mit von zu ist ein nicht sich auf auch dem des im".split(),
    "fr": "le les et des une est pas pour qui dans au par sur ce il plus".split(),
    "es": "el los las una del por con su al y se lo como más pero sus".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_CODE = {w.encode(): k + 1 for k, words in enumerate(FUNCTION_WORDS.values()) for w in words}


_EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def buckets(word: bytes) -> tuple[int, int, int]:
    """Hashed rows of an ASCII-lower-cased word: whole, first four, first six characters.

    ASCII punctuation at the edges is left out, other letters are lower-cased, too.
    """
    word = word.strip(_EDGES) or word
    if word.isascii():
        four, six = word[:4], word[:6]
    else:
        text = word.decode("utf-8", "replace").lower()
        word, four, six = text.encode("utf-8", "replace"), text[:4].encode("utf-8", "replace"), text[:6].encode("utf-8", "replace")
    crc = zlib.crc32
    return crc(word) % BUCKETS, crc(four, 4) % BUCKETS, crc(six, 6) % BUCKETS


class Words(dict):
    """Word -> number, in order of first use, with the words' hashed rows and language codes."""

    def __init__(self) -> None:
        super().__init__()
        self._rows, self._codes = np.zeros((0, 3), np.int32), np.zeros(0, np.int8)
        self._new: list[tuple[int, int, int]] = []
        self._new_codes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self._new.append(buckets(word))
        self._new_codes.append(_CODE.get(word, 0))
        n = self[word] = len(self)
        return n

    def _settle(self) -> None:
        if self._new:
            known, n = len(self._rows), len(self)
            rows = np.concatenate((self._rows[:known], np.array(self._new, np.int32)))
            self._rows, self._codes = rows[:n], np.concatenate((self._codes, np.array(self._new_codes, np.int8)))
            self._new, self._new_codes = [], []

    @property
    def rows(self) -> np.ndarray:
        self._settle()
        return self._rows

    @property
    def codes(self) -> np.ndarray:
        self._settle()
        return self._codes

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        """The hashed rows (words, 3) of a document."""
        return self.rows[numbers].astype(np.uint16)  # as many as BUCKETS

    def languages(self, docs: list[np.ndarray]) -> np.ndarray:
        """Index into ``LANGUAGES`` for each document."""
        codes, out = self.codes, []
        for numbers in docs:
            n = np.bincount(codes[numbers], minlength=len(LANGUAGES))[1:]
            out.append(int(n.argmax()) if n.any() else len(LANGUAGES) - 1)
        return np.array(out, np.int64)


#: Texts as the hashed rows of their words (words, 3), and their labels.
Block = tuple[list[np.ndarray], np.ndarray]


@dataclass
class Model:
    """Parameters: embeddings, filters by width (width, embedding, filters), biases, the logistic layer, thresholds by language."""

    embeddings: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    top: np.ndarray
    offset: float
    thresholds: list[float] = field(default_factory=lambda: [THRESHOLD] * len(LANGUAGES))

    def outputs(self, vectors: np.ndarray, blank: np.ndarray) -> Iterator[np.ndarray]:
        """(segments, SEGMENT, filters) for each width, for ``segments * SEGMENT + 2`` word vectors.

        Filters don't start at ``blank`` places: they would reach into the next document.
        """
        n = (len(vectors) - 2) // SEGMENT
        for width, w in self.filters.items():
            out = vectors[:n * SEGMENT] @ w[0]
            for k in range(1, width):
                out += vectors[k:k + n * SEGMENT] @ w[k]
            out += self.biases[width]
            out[blank[:n * SEGMENT]] = -1
            yield out.reshape(n, SEGMENT, -1)

    def maxima(self, vectors: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Segment maxima of all filters, at least 0."""
        return np.maximum(np.concatenate([out.max(axis=1) for out in self.outputs(vectors, blank)], axis=1), 0)

    def pooled(self, vectors: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment maxima and their places."""
        best, where = [], []
        for out in self.outputs(vectors, blank):
            at = out.argmax(axis=1)
            best.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0, :])
            where.append(at)
        return np.maximum(np.concatenate(best, axis=1), 0), np.concatenate(where, axis=1)

    def features(self, maxima: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per document: mean and greatest of its segments' maxima."""
        counts = np.diff(np.append(starts, len(maxima)))[:, None]
        return np.concatenate((np.add.reduceat(maxima, starts) / counts, np.maximum.reduceat(maxima, starts)), axis=1)

    def raw(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(features @ self.top + self.offset)

    def score(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Shifted so that the language's threshold becomes ``THRESHOLD``."""
        t = np.array(self.thresholds)[language]
        return _sigmoid(_logit(raw) - _logit(t) + _logit(np.array(THRESHOLD)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p.astype(np.float64), 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def _layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all documents in whole segments (-1: no word), each with room for a filter past its end; first segments."""
    sizes = [(len(d) + 2 + SEGMENT - 1) // SEGMENT for d in docs]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.full(starts[-1] * SEGMENT + 2, -1, np.int32)
    for d, s in zip(docs, starts, strict=False):
        flat[s * SEGMENT:s * SEGMENT + len(d)] = d
    return flat, starts[:-1]


class Learner:
    """A model in training, with Adagrad's sums of squares."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        f = sum(FILTERS.values())
        self.model = model = Model((rng.normal(0, 0.1, (BUCKETS, WIDTH))).astype(np.float32),
                                   {w: rng.normal(0, 0.3, (w, WIDTH, n)).astype(np.float32) for w, n in FILTERS.items()},
                                   {w: np.zeros(n, np.float32) for w, n in FILTERS.items()},
                                   np.full(2 * f, 0.1, np.float32) * rng.choice([-1, 1], 2 * f).astype(np.float32), 0.0)
        self.squares = {"e": np.full((BUCKETS, 1), 1e-3, np.float32), "top": np.full(2 * f, 1e-3), "offset": np.full(1, 1e-3),
                        **{("w", w): np.full_like(x, 1e-3) for w, x in model.filters.items()}, **{("b", w): np.full_like(x, 1e-3) for w, x in model.biases.items()}}

    def _rate(self, name: object, grad: np.ndarray, rate: float) -> np.ndarray:
        self.squares[name] = self.squares[name] + grad * grad
        return rate * grad / np.sqrt(self.squares[name])

    def _dense(self) -> list[np.ndarray]:
        m, q = self.model, self.squares
        return [*m.filters.values(), *m.biases.values(), m.top, *(q["w", w] for w in FILTERS), *(q["b", w] for w in FILTERS), q["top"], q["offset"]]

    def dense(self) -> np.ndarray:
        """All parameters and sums but those of hashed rows."""
        return np.concatenate([np.array([self.model.offset]), *(x.ravel().astype(np.float64) for x in self._dense())])

    def add(self, dense: np.ndarray) -> None:
        self.model.offset += float(dense[0])
        at = 1
        for x in self._dense():
            x += dense[at:at + x.size].reshape(x.shape).astype(x.dtype)
            at += x.size

    def hashed(self) -> np.ndarray:
        """Embeddings and their sums, one line per hashed row."""
        return np.concatenate((self.model.embeddings, self.squares["e"]), axis=1)

    def step(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One Adagrad step for a batch; the words of long texts are convolved piece by piece."""
        model, f = self.model, sum(FILTERS.values())
        sizes = np.array([len(d) for d in docs])
        rows, firsts = np.concatenate(docs), np.cumsum(sizes) - sizes
        flat, starts = _layout([np.arange(at, at + n, dtype=np.int32) for at, n in zip(firsts, sizes, strict=True)])
        # left-out words make every telling word count by itself, also beside others
        flat[rng.random(len(flat), np.float32) < LEFT_OUT] = -1

        def vectors(part: np.ndarray) -> np.ndarray:
            x, at = np.zeros((len(part), WIDTH), np.float32), np.flatnonzero(part >= 0)
            b = rows[part[at]]
            x[at] = model.embeddings[b[:, 0]] + model.embeddings[b[:, 1]] + model.embeddings[b[:, 2]]
            return x

        size = STEP_SEGMENTS * SEGMENT
        pieces = [flat[at:at + size + 2] for at in range(0, len(flat) - 2, size)]
        found, kept = [], None
        for part in pieces:
            kept = vectors(part)
            found.append(model.pooled(kept, part < 0))
        maxima, where = (np.concatenate(x) for x in zip(*found, strict=True))
        feats = model.features(maxima, starts)
        wrong = (model.raw(feats) - labels) * weight / len(docs)
        d_top, d_off = feats.T @ wrong, wrong.sum()
        d_feats = wrong[:, None] * model.top[None, :]
        counts = np.diff(np.append(starts, len(maxima)))
        doc = np.repeat(np.arange(len(docs)), counts)
        d_max = (d_feats[:, :f] / counts[:, None])[doc]
        greatest = feats[:, f:][doc] == maxima
        d_max = (d_max + d_feats[:, f:][doc] * greatest / np.maximum(np.add.reduceat(greatest, starts)[doc], 1)) * (maxima > 0)
        dw = {w: np.zeros_like(x) for w, x in model.filters.items()}
        db = {w: np.zeros_like(x) for w, x in model.biases.items()}
        hits = []
        for k, part in enumerate(pieces):
            x = kept if len(pieces) == 1 else vectors(part)
            own = slice(k * STEP_SEGMENTS, (k + 1) * STEP_SEGMENTS)
            hits.append(self._back(rows, part, x, d_max[own], where[own], dw, db))
        for width in FILTERS:
            model.filters[width] -= self._rate(("w", width), dw[width], rate).astype(np.float32)
            model.biases[width] -= self._rate(("b", width), db[width], rate).astype(np.float32)
        model.top -= self._rate("top", d_top, rate).astype(np.float32)
        model.offset -= float(self._rate("offset", np.array([d_off]), rate)[0])
        ids, ge = hits[0] if len(hits) == 1 else _summed(*(np.concatenate(x) for x in zip(*hits, strict=True)))
        self.squares["e"][ids] += (ge * ge).mean(axis=1, keepdims=True)
        model.embeddings[ids] -= rate * ge / np.sqrt(self.squares["e"][ids])

    def _back(self, rows: np.ndarray, part: np.ndarray, x: np.ndarray, d_max: np.ndarray, where: np.ndarray, dw: dict, db: dict) -> tuple[np.ndarray, np.ndarray]:
        """Adds the filters' gradients of a piece; its hashed rows and their gradients."""
        places = where + (np.arange(len(where)) * SEGMENT)[:, None]
        at, grads = [], []
        first = 0
        for width, n in FILTERS.items():
            g, p = d_max[:, first:first + n].astype(np.float32), places[:, first:first + n]
            first += n
            for k in range(width):
                dw[width][k] += np.einsum("sf,sfd->df", g, x[p + k])
                at.append((p + k).ravel())
                grads.append((g[:, :, None] * self.model.filters[width][k].T[None]).reshape(-1, WIDTH))
            db[width] += g.sum(axis=0)
        hit, dx = _summed(np.concatenate(at), np.concatenate(grads))
        told = np.any(dx, axis=1) & (part[hit] >= 0)
        return _summed(rows[part[hit[told]]].ravel(), np.repeat(dx[told], 3, axis=0))

    def visit(self, blocks: Iterable[Block], share: float, rate: float, batch: int, rng: np.random.Generator) -> int:
        """Steps through all rows once, each block in random order; how many rows there were.

        Rows of both classes weigh the same in sum: ``share`` is that of label 1 in all rows.
        """
        n = 0
        for docs, labels in blocks:
            n += len(docs)
            weight = np.where(labels > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3))
            own, size = [], 0
            for i in rng.permutation(len(docs)):
                if own and (len(own) == batch or size + len(docs[i]) > BATCH_WORDS):
                    self.step([docs[j] for j in own], labels[own], weight[own], rate, rng)
                    own, size = [], 0
                own.append(i)
                size += len(docs[i])
            if own:
                self.step([docs[j] for j in own], labels[own], weight[own], rate, rng)
        return n


def _summed(ids: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their gradients."""
    ids, back = np.unique(ids, return_inverse=True)
    cells = back.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
    return ids, np.bincount(cells.ravel(), grads.ravel(), len(ids) * WIDTH).reshape(-1, WIDTH).astype(np.float32)


def _share(n: int, n_toxic: int) -> float:
    return max(n_toxic / n, 1e-3) if n else 0.5


def _passes(n: int, visits: int = VISITS) -> int:
    return int(min(PASSES[1], max(PASSES[0], visits // max(1, n))))


def _pass_rate(k: int, passes: int) -> float:
    return 0.1 * (1 - k / passes)


def fit(texts: list[bytes], labels: np.ndarray, calibrate: np.ndarray, visits: int = VISITS, batch: int = 32, seed: int = 1) -> Model:
    """:func:`train` for a few texts at hand: learns from the rows that ``calibrate`` doesn't mark, sets the thresholds on those that it does.

    Every row is visited equally often: 8 to 30 times, about ``visits`` visits in all.
    """
    words, learner, rng = Words(), Learner(seed), np.random.default_rng(seed)
    docs = [words.numbers(t) for t in texts]
    rows = np.flatnonzero(~calibrate)
    passes = _passes(len(rows), visits)
    for k in range(passes):
        learner.visit([([words.hashed(docs[i]) for i in rows], labels[rows])], _share(len(rows), labels[rows].sum()), _pass_rate(k, passes), batch, rng)
    held = np.flatnonzero(calibrate)
    if len(held):
        raw = np.concatenate([_raw(learner.model, words, [docs[i]]) for i in held])
        one = np.ones(len(held), np.int64)
        _calibrate(learner.model, words.languages([docs[i] for i in held]), raw, raw, one, labels[held])
    return learner.model


def _calibrate(model: Model, language: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, right: np.ndarray, least: int = 10) -> None:
    """Threshold of best F1 for each language with ``least`` rows of both classes, of all rows else.

    Each entry counts ``n`` rows with raw scores from ``low`` to ``high``, ``right`` of them labelled.
    """
    everywhere = _best(low, high, n, right) if 0 < right.sum() < n.sum() else THRESHOLD
    for k in range(len(LANGUAGES)):
        own = language == k
        toxic = right[own].sum()
        model.thresholds[k] = _best(low[own], high[own], n[own], right[own]) if min(toxic, n[own].sum() - toxic) >= least else everywhere


def _best(low: np.ndarray, high: np.ndarray, n: np.ndarray, right: np.ndarray) -> float:
    """The middle (in log odds) of the gap below the score at which F1 is best."""
    order = np.argsort(-low)
    low, high, n, right = low[order], high[order], n[order], right[order]
    f1 = 2 * np.cumsum(right) / (np.cumsum(n) + right.sum())
    f1[np.append(high[1:] >= low[:-1], False)] = -1
    k = int(f1.argmax())
    below = high[k + 1] if k + 1 < len(low) else low[k]
    return float(_sigmoid((_logit(low[k]) + _logit(below)) / 2))


def _raw(model: Model, words: Words, docs: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
    """Raw scores; ``table`` has the vectors of all words, if they are at hand."""
    flat, starts = _layout(docs)
    maxima = []
    for at in range(0, len(flat) - 2, STEP_SEGMENTS * SEGMENT):
        part = flat[at:at + STEP_SEGMENTS * SEGMENT + 2]
        if table is None:
            b = words.rows[part] if len(words) else np.zeros((len(part), 3), np.int32)
            x = model.embeddings[b[:, 0]] + model.embeddings[b[:, 1]] + model.embeddings[b[:, 2]]
        else:
            x = table[part]
        x[part < 0] = 0
        maxima.append(model.maxima(x, part < 0))
    return model.raw(model.features(np.concatenate(maxima), starts))


class Scorer:
    """Scores texts with a bounded memory of word vectors."""

    def __init__(self, model: Model) -> None:
        self.model, self.words, self.table = model, Words(), np.zeros((0, WIDTH), np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out, docs, size, done = np.zeros(len(texts)), [], 0, 0
        for k, text in enumerate(texts):
            if len(self.words) > CACHE_WORDS and not docs:
                self.words, self.table = Words(), self.table[:0]
            docs.append(self.words.numbers(text))
            size += len(docs[-1]) + SEGMENT
            if size >= STEP_SEGMENTS * SEGMENT or k + 1 == len(texts):
                out[done:k + 1] = self.model.score(_raw(self.model, self.words, docs, self._vectors()), self.words.languages(docs))
                docs, size, done = [], 0, k + 1
        return out

    def _vectors(self) -> np.ndarray:
        known, n = len(self.table), len(self.words)
        if n > known:
            b, e = self.words.rows[known:n], self.model.embeddings
            grown = np.empty((n, WIDTH), np.float32)
            grown[:known] = self.table
            grown[known:] = e[b[:, 0]] + e[b[:, 1]] + e[b[:, 2]]
            self.table = grown
        return self.table if n else np.zeros((1, WIDTH), np.float32)


def _cut(sizes: Iterable[int]) -> Iterator[int]:
    """Where blocks of bounded rows and bytes end (a longer row is a block by itself)."""
    rows = size = at = 0
    for at, n in enumerate(sizes):
        if rows and (rows == BLOCK_ROWS or size + n > BLOCK_BYTES):
            yield at
            rows = size = 0
        rows, size = rows + 1, size + n
    if rows:
        yield at + 1


def _encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``held, label, text`` -> ``held, label, text`` for the rows that set thresholds, the words' hashed rows as bytes for those that train."""
    words = Words()
    for part in parts:
        out = []
        for held, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
            if not held:
                if len(words) > CACHE_WORDS:
                    words = Words()
                text = words.hashed(words.numbers(text)).tobytes()
            out.append(text)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["held", "label", "text"])


def _blocks(parts: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for part in parts:
        start, sizes = 0, pc.binary_length(part.column(1)).to_pylist()
        for end in _cut(sizes):
            texts = part.column(1).slice(start, end - start).to_pylist()
            labels = part.column(0).slice(start, end - start).to_numpy().astype(np.float64)
            yield [np.frombuffer(t, np.uint16).reshape(-1, 3) for t in texts], labels
            start = end


def _one_round(rows: DataFrame, learner: Learner, share: float, rates: list[float], first: int, batch: int, seed: int) -> None:
    """``learner`` after one pass at each rate, by every task over its own rows; then the tasks' changes are averaged.

    A hashed row changes by the mean of the tasks that met it, all other
    parameters by the mean of all tasks, weighted by their rows.
    """
    held = rows.sparkSession.sparkContext.broadcast(learner)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, old = copy.deepcopy(held.value), held.value.hashed()
        rng = np.random.default_rng([seed, first, TaskContext.get().partitionId()])
        blocks = _blocks(parts)
        if len(rates) > 1:
            blocks = list(blocks)
        n = 0
        for rate in rates:
            n = own.visit(blocks, share, rate, batch, rng)
        if n:
            delta = own.hashed() - old
            payloads = [(own.dense() - held.value.dense()).tobytes(), *(delta[at:at + SLICE].tobytes() for at in range(0, BUCKETS, SLICE))]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(payloads) - 1), pa.int32()), pa.array([n] * len(payloads), pa.int64()), pa.array(payloads, pa.binary())],
                                             names=["slice", "n", "delta"])

    def mean(part: pa.Table) -> pa.Table:
        dense = part.column("slice")[0].as_py() < 0
        total, met, weight = 0.0, 0, 0
        for n, payload in zip(part.column("n").to_pylist(), part.column("delta"), strict=True):
            if dense:
                total, weight = total + n * np.frombuffer(payload.as_py(), np.float64), weight + n
            else:
                delta = np.frombuffer(payload.as_py(), np.float32).reshape(-1, WIDTH + 1)
                total, met = total + delta, met + np.any(delta, axis=1, keepdims=True)
        total = total / weight if dense else (total / np.maximum(met, 1)).astype(np.float32)
        return pa.table({"slice": part.column("slice")[:1], "delta": pa.array([total.tobytes()], pa.binary())})

    changes = rows.select("label", "text").mapInArrow(run, "slice int, n long, delta binary").groupBy("slice").applyInArrow(mean, "slice int, delta binary")
    for k, payload in zip(*changes.toArrow().columns, strict=True):
        k, payload = k.as_py(), payload.as_py()
        if k < 0:
            learner.add(np.frombuffer(payload, np.float64))
        else:
            delta = np.frombuffer(payload, np.float32).reshape(-1, WIDTH + 1)
            at = slice(k * SLICE, (k + 1) * SLICE)
            learner.model.embeddings[at] += delta[:, :WIDTH]
            learner.squares["e"][at] += delta[:, WIDTH:]
    held.destroy()


def _calibrated(rows: DataFrame, model: Model) -> None:
    """Thresholds from all of ``rows``; the driver gets counts by language and score."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in parts:
            labels, start = part.column(0), 0
            for end in _cut(pc.binary_length(part.column(1)).to_pylist()):
                if len(words) > CACHE_WORDS:
                    words = Words()
                docs = [words.numbers(t) for t in part.column(1).slice(start, end - start).to_pylist()]
                raw = np.concatenate([_raw(held.value, words, [d]) for d in docs])
                step = np.floor(_logit(raw) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(words.languages(docs).astype(np.int32)), pa.array(step), pa.array(raw.astype(np.float64)), labels.slice(start, end - start)],
                                                 names=["language", "step", "raw", "label"])
                start = end

    scored = rows.select("label", "text").mapInArrow(run, "language int, step int, raw double, label int")
    counts = scored.groupBy("language", "step").agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("*").alias("n"), F.sum("label").alias("right")).toArrow()
    if counts.num_rows:
        _calibrate(model, *(counts.column(c).to_numpy() for c in ("language", "low", "high", "n", "right")))
    held.destroy()


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", visits: int = VISITS, batch: int = 32, seed: int = 1, part_bytes: int = PART_BYTES) -> Model:
    """Fit on every labelled row outside the held-out fold, whole texts: three quarters (by hash of the id) train, one sets the thresholds.

    Each training task has ``part_bytes`` bytes of text or more.  If that
    makes one task, it goes over its rows as often as needed; else rounds of
    a few passes over the rows each start from the averaged model.
    An id labelled twice counts as toxic if it is so once, an id with
    several texts has the smallest; null ids and labels are left out.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "toxicity")
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_out_fold))
             .groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label")))
    texts = (docs.filter(crc_mod(id_col, folds) != held_out_fold)
             .select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")))
    order = F.xxhash64("id")
    found = (texts.join(known, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
             .select((F.pmod(F.shiftright(order, 20), F.lit(4)) == 0).alias("held"), order.alias("h"), "label", "text"))
    rows = scratch.save(found.sortWithinPartitions("h").select("held", "label", "text").mapInArrow(_encoded, "held boolean, label int, text binary"), "rows")
    train_rows, held_rows = rows.filter("not held"), rows.filter("held")
    n, toxic, size = train_rows.agg(F.count("*"), F.sum("label"), F.sum(F.octet_length("text"))).first()
    learner, passes = Learner(seed), _passes(n, visits)
    if n:
        share = _share(n, toxic)
        parts = min(MOST_PARTS, max(1, size // part_bytes))
        rates = [_pass_rate(k, passes) for k in range(passes)]
        train_rows = train_rows.coalesce(parts)
        several = passes if parts == 1 else ROUND_PASSES if size // parts <= HELD_BYTES else 1
        for first in range(0, passes, several):
            _one_round(train_rows, learner, share, rates[first:first + several], first, batch, seed)
    _calibrated(held_rows, learner.model)
    scratch.drop("rows")
    return learner.model


def score_documents(docs: DataFrame, model: Model, folds: int = 3, held_out_fold: int = 1, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, whole texts.

    A null text counts as empty; an empty text has the score of no words.
    Nulls in ids stay (they hash as '').  Repeated rows are scored each.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for part in parts:
            scores = scorer(utf8_bytes(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, folds) == held_out_fold).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns as they were."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for part in parts:
            yield part.filter(pa.array(scorer(utf8_bytes(part.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
