"""Static 8-bit binary-fuse filters over 64-bit keys, built and probed with numpy.

Three-wise binary fuse filters as published by Graf and Lemire: about nine
bits a key, no false negatives, one false positive in 256.  A filter never
changes once built; it belongs to one immutable snapshot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over key + seed."""
    h = keys + _U(seed & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    windows: int
    cells: np.ndarray

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _slots(h, self.segment, self.windows)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """False where the key is surely absent."""
        if not len(self.cells):
            return np.zeros(len(keys), bool)
        h = _mix(keys, self.seed)
        a, b, c = self._slots(h)
        return (self.cells[a] ^ self.cells[b] ^ self.cells[c]) == _print(h)


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(32))).astype(np.uint8)


def _slots(h: np.ndarray, segment: int, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three cells in three consecutive segments."""
    mask = _U(segment - 1)
    first = ((h >> _U(32)) * _U(windows * segment)) >> _U(32)
    second = (first + _U(segment)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def build(keys: np.ndarray, attempts: int = 100) -> FuseFilter:
    """Filter of the distinct ``keys`` (uint64); an empty set gives a filter that holds nothing."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return FuseFilter(0, 1, 1, np.zeros(0, np.uint8))
    segment = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    windows = max(1, math.ceil(n * factor / segment) - 2)
    size = (windows + 2) * segment
    for attempt in range(attempts):
        seed = 0x9E3779B97F4A7C15 * (attempt + 1)
        h = _mix(keys, seed)
        order = _peel(_slots(h, segment, windows), n, size)
        if order is not None:
            cells = np.zeros(size, np.uint8)
            prints, slots = _print(h), _slots(h, segment, windows)
            for rows, own in reversed(order):
                cells[own] = 0
                cells[own] = prints[rows] ^ cells[slots[0][rows]] ^ cells[slots[1][rows]] ^ cells[slots[2][rows]]
            return FuseFilter(seed & 0xFFFFFFFFFFFFFFFF, segment, windows, cells)
    raise ValueError(f"no peeling order for {n} keys")


def _peel(slots: tuple[np.ndarray, ...], n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell that each has for itself); None if some keys can't be peeled.

    A cell used by one remaining key is that key's own.  Keys of one round
    never use each other's own cells, so a round is peeled at once.
    """
    count, xor = np.zeros(size, np.int32), np.zeros(size, np.int64)
    for s in slots:
        np.add.at(count, s, 1)
        np.bitwise_xor.at(xor, s, np.arange(n))
    order, left = [], n
    candidates = np.flatnonzero(count == 1)
    while len(candidates):
        rows, at = np.unique(xor[candidates], return_index=True)
        order.append((rows, candidates[at]))
        left -= len(rows)
        touched = []
        for s in slots:
            np.subtract.at(count, s[rows], 1)
            np.bitwise_xor.at(xor, s[rows], rows)
            touched.append(s[rows])
        touched = np.unique(np.concatenate(touched))
        candidates = touched[count[touched] == 1]
    return order if not left else None
