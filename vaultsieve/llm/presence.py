"""A sparse matrix of ones for fitting linear models within one bounded task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Entries that are worked on at a time, which bounds the memory that products take.
BLOCK = 1 << 19


class Presence:
    """Rows of distinct column numbers."""

    def __init__(self, rows: Iterable[np.ndarray], width: int):
        rows = [np.asarray(x, np.int32) for x in rows]
        self.sizes = np.array([len(x) for x in rows], np.int64)
        self.ends = np.append(0, np.cumsum(self.sizes))
        self.columns = np.concatenate([*rows, np.zeros(0, np.int32)])
        self.width = width

    def _blocks(self) -> Iterator[tuple[int, int]]:
        first = 0
        while first < len(self.sizes):
            last = max(first + 1, int(np.searchsorted(self.ends, self.ends[first] + BLOCK, "right")) - 1)
            yield first, last
            first = last

    def times(self, weight: np.ndarray) -> np.ndarray:
        """For each row, the sum of its columns' weights."""
        out = np.zeros(len(self.sizes))
        for a, b in self._blocks():
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), self.sizes[a:b]), weight[self.columns[self.ends[a] : self.ends[b]]], minlength=b - a)
        return out

    def turned(self, value: np.ndarray) -> np.ndarray:
        """For each column, the sum of its rows' values."""
        out = np.zeros(self.width)
        for a, b in self._blocks():
            out += np.bincount(self.columns[self.ends[a] : self.ends[b]], np.repeat(value[a:b], self.sizes[a:b]), minlength=self.width)
        return out
