"""Token counts by dynamic programming over a trie of pre-tokens (operator 1).

The distinct pre-tokens of a task go into a trie.  A node is a prefix, and
its unigram forward score (the best segmentation of the prefix) is worked
out once, from the nodes above it, for all pre-tokens that share it.  A
pre-token's last node stores its number of tokens; documents add these up.
No row moves between tasks, and the trie is emptied when it is full.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import ship_package, utf8_bytes

#: Nodes at which a trie is emptied, and characters beyond which a pre-token is worked out beside the trie.
TRIE_NODES, LONG_TOKEN = 800_000, 256

_OUT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


class Trie:
    """Prefixes of pre-tokens with their best score and that segmentation's length."""

    def __init__(self, vocabulary: pieces.Vocabulary) -> None:
        self.v = vocabulary
        #: Every end of a piece -> the piece's log-probability, or None where no piece begins.
        self.ends: dict[str, float | None] = {}
        for piece, logp in vocabulary.steps.items():
            if logp is not None:
                for k in range(1, len(piece)):
                    self.ends.setdefault(piece[k:], None)
        self.ends |= {p: s for p, s in vocabulary.steps.items() if s is not None}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("i", [0])
        self.terminal: dict[bytes, int] = {}

    def lookup(self, word: bytes) -> tuple[int, float]:
        """(tokens, score) of a pre-token; it is inserted if it is new."""
        node = self.terminal.get(word)
        if node is None:
            token = pieces.MARK + word.decode("utf-8", "replace")
            if len(token) > LONG_TOKEN or pieces.MARK in token[1:]:
                return self._beside(token)
            node = self.terminal[word] = self._insert(token)
        return self.count[node], self.best[node]

    def _insert(self, token: str) -> int:
        child, best, count = self.child, self.best, self.count
        node, scores, sizes = 0, [0.0], [0]
        for char in token:  # the prefix that the trie has
            down = child.get(node << 21 | ord(char))
            if down is None:
                break
            node = down
            scores.append(best[node])
            sizes.append(count[node])
        for n in range(len(scores), len(token) + 1):
            score, tokens = self._extend(token, n, scores, sizes)
            down = child[node << 21 | ord(token[n - 1])] = len(best)
            best.append(score)
            count.append(tokens)
            scores.append(score)
            sizes.append(tokens)
            node = down
        return node

    def _beside(self, token: str) -> tuple[int, float]:
        """As :meth:`_insert`, leaving the trie alone."""
        scores, sizes = [0.0], [0]
        for n in range(1, len(token) + 1):
            score, tokens = self._extend(token, n, scores, sizes)
            scores.append(score)
            sizes.append(tokens)
        return sizes[-1], scores[-1]

    def _extend(self, token: str, n: int, scores: list[float], sizes: list[int]) -> tuple[float, int]:
        """Forward score of the prefix of ``n`` characters from those of shorter ones; fewer tokens win ties.

        A word mark inside the token is spelled in bytes.
        """
        get, mark, top, tokens = self.ends.get, pieces.MARK, -math.inf, 0
        i = n - 1
        while i >= 0:
            p = get(token[i:n], 0.0)
            if p == 0.0 or i and token[i] == mark:
                break
            if p is not None:
                s = scores[i] + p
                if s > top or s == top and sizes[i] + 1 < tokens:
                    top, tokens = s, sizes[i] + 1
            i -= 1
        char = token[n - 1]
        if n > 1 and char == mark or get(char) is None:
            s, spelled = scores[n - 1] + self.v.spelled(char), len(char.encode("utf-8", "surrogatepass"))
            if s > top or s == top and sizes[n - 1] + spelled < tokens:
                top, tokens = s, sizes[n - 1] + spelled
        return top, tokens


def count_tokens(docs: DataFrame, vocabulary_path: str = pieces.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, score`` for every row of ``docs``.

    A pre-token is a run of non-white-space with the word mark before it;
    ``n_tokens`` are the pieces of the best segmentations, ``score`` the sum
    of their natural-log probabilities.  Null and empty texts have none and
    score 0.  Null ids stay; repeated rows are counted each; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(pieces.load(vocabulary_path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary.value)
        for part in parts:
            words, tokens, scores = [], [], []
            for text in utf8_bytes(part.column(1)):
                if len(trie.best) > TRIE_NODES:
                    trie.clear()
                n, total, score = 0, 0, 0.0
                for word, times in Counter(text.split()).items():
                    t, s = trie.lookup(word)
                    n += times
                    total += times * t
                    score += times * s
                words.append(n)
                tokens.append(total)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], schema=_OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
