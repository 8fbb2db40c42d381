"""An FM-index over a sequence of small numbers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

from tillstream.llm.suffixes import Suffixes


class WaveletMatrix:
    """Numbers of ``bits`` bits each; one row of zero counts per bit, highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for bit in range(bits - 1, -1, -1):
            high = (values >> bit) & 1 == 1
            self.ones.append(np.concatenate([[0], np.cumsum(high)]).astype(np.int32))
            self.zeros.append(int(len(values) - self.ones[-1][-1]))
            values = np.concatenate([values[~high], values[high]])

    def rank(self, value: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each ``value`` stands before place ``end``."""
        low, high = np.zeros_like(end), end
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = (value >> bit) & 1 == 1
            below, above = self.ones[level][low], self.ones[level][high]
            low = np.where(one, self.zeros[level] + below, low - below)
            high = np.where(one, self.zeros[level] + above, high - above)
        return high - low


class FMIndex:
    """Index of ``values``, numbers from 1 to ``largest``; 0 separates sequences that no pattern may span."""

    def __init__(self, values: np.ndarray, largest: int, sample: int = 16):
        n = len(values) + 1
        text = np.append(values + 1, 0)  # a single smallest value ends the text
        suffixes = Suffixes(text, np.full(n, n))
        order = suffixes.order
        self.n = n
        self.last = text[order - 1]  # the value in front of each suffix
        self.before = np.searchsorted(np.sort(text), np.arange(largest + 3))
        self.tree = WaveletMatrix(self.last, max(1, int(largest + 2).bit_length()))
        self.sampled = order % sample == 0
        self.position = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern. Rows of ``patterns`` are padded on the left."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        for back in range(1, patterns.shape[1] + 1):
            at = np.flatnonzero((lengths >= back) & (low < high))
            if not len(at):
                break
            value = patterns[at, -back] + 1
            low[at] = self.before[value] + self.tree.rank(value, low[at])
            high[at] = self.before[value] + self.tree.rank(value, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes, walked back to the nearest sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            at = rows[todo]
            value = self.last[at]
            rows[todo] = self.before[value] + self.tree.rank(value, at)
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.position[rows] + steps
