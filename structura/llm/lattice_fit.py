"""Expected piece counts over the segmentation lattices of many words.

The forward sums of a lattice and the backward sums of the same edges
give every edge's share of all segmentations of its word.  A piece's
expected count is the sum of its edges' shares over the words, each as
often as the word counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from .lattice_batch import BatchLattice
from .pieces import MARK, Vocabulary, from_scores

#: Shares are summed in whole units of this size, so that the sums don't depend on how words meet in tasks.
UNIT = 1.0 / (1 << 16)


class Expectation:
    """Units that tokens are expected to take: ``taken`` by place in the lattice, ``spelled`` by byte."""

    def __init__(self, lattice: BatchLattice) -> None:
        self.lattice = lattice
        self.taken, self.spelled = np.zeros(len(lattice.keys), np.int64), np.zeros(256, np.int64)
        self.place = {lattice.names[k]: k for k in np.flatnonzero(lattice.logp > -np.inf).tolist()}
        self.longest = max(map(len, self.place), default=1)

    def add(self, tokens: list[str], counts: np.ndarray) -> None:
        """Tokens begin with the word mark; the k-th occurs ``counts[k]`` times."""
        groups, rest = self.lattice.groups(tokens)
        for places, chars in groups:
            self._bulk(chars, counts[places])
        for k in rest:
            self._one(tokens[k], int(counts[k]))

    def _bulk(self, chars: np.ndarray, counts: np.ndarray) -> None:
        n, m = chars.shape
        alpha, beta = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        alpha[0], beta[n] = 0, 0
        edges = list(self.lattice.edges(chars))
        for i, j, rows, p, _ in edges:
            alpha[j][rows] = np.logaddexp(alpha[j][rows], alpha[i][rows] + p)
        for i, j, rows, p, at in reversed(edges):
            ahead = beta[j][rows] + p
            share = np.exp(alpha[i][rows] + ahead - alpha[n][rows])
            beta[i][rows] = np.logaddexp(beta[i][rows], ahead)
            units = np.rint(share * counts[rows] / UNIT).astype(np.int64)
            if at[0] >= 0:  # edges that come together are all pieces or all spelled in bytes
                np.add.at(self.taken, at, units)
                continue
            codes = chars[i][rows]
            for code in np.unique(codes).tolist():
                self._spell(chr(code), int(units[codes == code].sum()))

    def _spell(self, char: str, units: int) -> None:
        for b in char.encode("utf-8", "surrogatepass"):
            self.spelled[b] += units

    def _into(self, token: str, j: int) -> Iterator[tuple[int, float, int]]:
        """(start, log-probability, place or -1) of the edges that end at ``j``; nothing is kept, for tokens of any length."""
        v = self.lattice.v
        for i in range(max(0, j - self.longest), j):
            inner_mark = i and token[i] == MARK
            at = -1 if inner_mark else self.place.get(token[i:j], -1)
            if at >= 0:
                yield i, v.steps[token[i:j]], at
            elif i == j - 1:
                yield i, v.spelled(token[i]), -1

    def _one(self, token: str, count: int) -> None:
        n = len(token)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0], beta[n] = 0, 0
        for j in range(1, n + 1):
            for i, p, _ in self._into(token, j):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + p)
        for j in range(n, 0, -1):
            for i, p, at in self._into(token, j):
                ahead = beta[j] + p
                beta[i] = np.logaddexp(beta[i], ahead)
                units = round(math.exp(alpha[i] + ahead - alpha[n]) * count / UNIT)
                if at >= 0:
                    self.taken[at] += units
                else:
                    self._spell(token[i], units)


def reweighted(lattice: BatchLattice, taken: dict[int, int], spelled: dict[int, int], ends: int, prior: Vocabulary) -> Vocabulary:
    """The pieces with probabilities in proportion to their expected counts and the prior's share of one count per piece.

    ``taken`` and ``spelled``: units by place and byte; ``ends``: the ends
    of texts.  Every piece keeps a share, so every word keeps its
    segmentations; without any counts the prior comes back.
    """
    places = np.flatnonzero(lattice.logp > -np.inf).tolist()
    mass = len(places)

    def log_weight(count: float, prior_logp: float) -> float:
        return math.log(count + mass * math.exp(prior_logp))

    pieces = [(name, log_weight(taken.get(k, 0) * UNIT, prior.steps[name]), prior.ids[name]) for k, name in ((k, lattice.names[k]) for k in places)]
    of_byte = [(log_weight(spelled.get(b, 0) * UNIT, prior.byte_logp[b]), prior.byte_ids[b]) for b in range(256)]
    return from_scores(pieces, of_byte, log_weight(ends, prior.end_logp), prior.names)
