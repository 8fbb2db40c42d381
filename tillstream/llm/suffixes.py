"""Suffix arrays of number sequences by prefix doubling, over whole arrays."""

from __future__ import annotations

import numpy as np


def _groups(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per sorted place: the place where its group of equal keys begins, and whether the group has one member."""
    ordered = keys[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(order)))
    return np.repeat(begin, size), np.repeat(size == 1, size)


class Suffixes:
    """The suffixes of sequences that stand end to end, sorted; none reaches past the end of its own sequence.

    ``ranks[k]`` numbers each position by its first 2**k values: positions have equal ranks exactly if they lie in the
    same sequence (see ``keys``) and these values are equal. Positions whose prefix is unique are sorted no further.
    """

    def __init__(self, keys: np.ndarray, end: np.ndarray):
        """``keys``: a number per position; positions of different sequences have different ones, if their suffixes
        are not to be compared. ``end``: where the position's sequence ends."""
        n = len(keys)
        self.end = end
        order = np.argsort(keys, kind="stable")
        begin, alone = _groups(keys, order)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = begin
        self.ranks = [rank.astype(np.int32)]
        active = order[~alone]
        step = 1
        while len(active):
            ahead = active + step
            within = ahead < end[active]
            follower = np.zeros(len(active), dtype=np.int64)
            follower[within] = rank[ahead[within]] + 1
            pair = rank[active] * (n + 1) + follower
            place = np.argsort(pair, kind="stable")
            active, pair = active[place], pair[place]
            old = rank[active]
            begin, alone = _groups(pair, np.arange(len(pair)))
            # The old rank is the place of its group's first member in the whole order; add the place within the group.
            first = np.searchsorted(old, old, side="left")
            rank = rank.copy()
            rank[active] = old + begin - first
            self.ranks.append(rank.astype(np.int32))
            active = active[~alone]
            step *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of pairs of suffixes."""
        length = np.zeros(len(left), dtype=np.int64)
        if not len(left):
            return length
        last = len(self.end) - 1
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            a, b = left + length, right + length
            inside = (a < self.end[left]) & (b < self.end[right])
            same = inside & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]) & (left != right)
            length[same] += 1 << level
        return length

    def longest_repeats(self, at_least: int) -> np.ndarray:
        """Per position, the length of its longest prefix that some other position has too; 0 if below ``at_least``.

        Neighbours in the order share the longest prefixes, so the larger of the two common lengths is it.
        """
        n = len(self.end)
        found = np.zeros(n, dtype=np.int64)
        if n < 2:
            return found
        level = max(0, min(at_least.bit_length() - 1, len(self.ranks) - 1))
        if 1 << level > at_least:
            level = 0
        left, right = self.order[:-1], self.order[1:]
        close = self.ranks[level][left] == self.ranks[level][right]
        left, right = left[close], right[close]
        length = self.common(left, right)
        length[length < at_least] = 0
        np.maximum.at(found, left, length)
        np.maximum.at(found, right, length)
        return found


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of the positions 0 to n - 1 some stretch covers."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of true values; a run ends before each position in ``breaks``."""
    before = np.empty_like(mask)
    before[1:] = mask[:-1]
    before[:1] = False
    cut = breaks[breaks < len(mask)]
    before[cut] = False
    after = np.empty_like(mask)
    after[:-1] = mask[1:]
    after[-1:] = False
    after[cut[cut > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
