"""Forward passes over the piece lattices of many words at once, with numpy.

Words of one length stand side by side; a pass goes over start positions
and piece lengths.  Prefixes of pieces are looked up by a 64-bit rolling
hash, and a word leaves the row as soon as no piece goes on.  Words that
are long or hold the word mark inside are left to the scalar forms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from .pieces import MARK, Vocabulary

#: Longest token (mark included) that is worked out in bulk.
LONGEST = 40
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class BatchLattice:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        prefixes = list(vocabulary.steps)
        hashes = np.array([_hash(p) for p in prefixes], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two prefixes of pieces share a hash")
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.logp = np.array([-np.inf if vocabulary.steps[p] is None else vocabulary.steps[p] for p in prefixes])[order]
        self.ids = np.array([vocabulary.ids.get(p, -1) for p in prefixes], np.int32)[order]
        self.names = [prefixes[k] for k in order]

    def groups(self, tokens: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
        """(places, code points) of the tokens by length, and the places of those for the scalar forms."""
        by: defaultdict[int, list[int]] = defaultdict(list)
        rest = []
        for k, t in enumerate(tokens):
            if len(t) > LONGEST or MARK in t[1:]:
                rest.append(k)
            else:
                by[len(t)].append(k)
        out = []
        for n, places in by.items():
            text = "".join([tokens[k] for k in places]).encode("utf-32-le", "surrogatepass")
            out.append((np.array(places), np.frombuffer(text, "<u4").reshape(-1, n).T.copy()))
        return out, rest

    def edges(self, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, rows, log-probabilities, places in the vocabulary) of all edges by start.

        A single character that is no piece comes as an edge of place -1
        with the probability of its bytes.
        """
        n, m = chars.shape
        code = chars.astype(np.uint64) + np.uint64(1)
        last = len(self.keys) - 1
        for i in range(n):
            rows, h = np.arange(m), np.zeros(m, np.uint64)
            for j in range(i + 1, n + 1):
                h = h * _BASE + code[j - 1][rows]
                at = np.searchsorted(self.keys, h)
                np.minimum(at, last, out=at)
                hit = self.keys[at] == h
                if not hit.all():
                    rows, h, at = rows[hit], h[hit], at[hit]
                p = self.logp[at]
                whole = p > -np.inf
                if whole.all():
                    if len(rows):
                        yield i, j, rows, p, at
                elif whole.any():
                    yield i, j, rows[whole], p[whole], at[whole]
                if j == i + 1:
                    lone = np.ones(m, bool)
                    lone[rows[whole]] = False
                    lone = np.flatnonzero(lone)
                    if len(lone):
                        yield i, j, lone, np.array([self.v.spelled(chr(c)) for c in chars[i][lone]]), np.full(len(lone), -1)
                if not len(rows):
                    break

    def two_best(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best and second-best score of each token, starts of the best pieces by end, and their places in the vocabulary."""
        n, m = chars.shape
        first, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back, via = np.zeros((n + 1, m), np.int16), np.zeros((n + 1, m), np.int32)
        first[0] = 0
        for i, j, rows, p, at in self.edges(chars):
            a, b, f, s = first[i][rows] + p, second[i][rows] + p, first[j][rows], second[j][rows]
            better = a > f
            first[j][rows] = np.where(better, a, f)
            second[j][rows] = np.where(better, np.maximum(f, b), np.maximum(s, a))
            up = rows[better]
            back[j][up] = i
            via[j][up] = at[better]
        return first[n], second[n], back, via

    def best_ids(self, back: np.ndarray, via: np.ndarray) -> list[np.ndarray | None]:
        """Ids of each token's best pieces; None where a character is spelled in bytes."""
        n, m = back.shape[0] - 1, back.shape[1]
        out, place = np.zeros((m, n), np.int32), np.full(m, n)
        at, whole, rows = np.full(m, n), np.ones(m, bool), np.arange(m)
        while len(rows):
            v = via[at[rows], rows]
            whole[rows[v < 0]] = False
            place[rows] -= 1
            out[rows, place[rows]] = self.ids[np.maximum(v, 0)]
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return [out[k, place[k]:] if whole[k] else None for k in range(m)]

    def marginals(self, tokens: list[str]) -> np.ndarray:
        """Log of the summed probability of all segmentations of each token."""
        out = np.empty(len(tokens))
        groups, rest = self.groups(tokens)
        for k in rest:
            out[k] = self.v.marginal(tokens[k])
        for places, chars in groups:
            out[places] = self.alpha(chars)[-1]
        return out

    def alpha(self, chars: np.ndarray) -> np.ndarray:
        """Forward log sums of all prefixes (position, token)."""
        alpha = np.full((chars.shape[0] + 1, chars.shape[1]), -np.inf)
        alpha[0] = 0
        for i, j, rows, p, _ in self.edges(chars):
            alpha[j][rows] = np.logaddexp(alpha[j][rows], alpha[i][rows] + p)
        return alpha
