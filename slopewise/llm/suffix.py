"""Suffix arrays over sequences of words, by prefix doubling with numpy inside a task.

Ranks of suffixes are refined to twice the depth in each round; only suffixes that still share their rank go on, so
text that hardly repeats costs little more than one sort.
"""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """`order`: positions of the suffixes that take part, sorted by their first `depth` words (all of them by default).

    `words`: a number for each word. `part`: which positions take part; the others never equal anything, so no
    common prefix extends over them.
    """

    def __init__(self, words: np.ndarray, part: np.ndarray | None = None, depth: int | None = None):
        n = len(words)
        own = np.arange(n) if part is None else np.flatnonzero(part)
        rank = np.full(n + 1, -1, np.int64)  # the last place stands for the end
        if part is not None:
            rank[:n] = -2 - np.arange(n)  # all different
        order = own[np.argsort(words[own], kind="stable")]
        new = np.diff(words[order], prepend=words[order[:1]] ^ words.dtype.type(1)) != 0
        start = np.flatnonzero(new)
        sizes = np.diff(start, append=len(order))
        rank[order] = np.repeat(start, sizes)
        self.levels = [self._level(order, rank, sizes, np.arange(len(order)))]
        length, live = 1, np.flatnonzero(np.repeat(sizes > 1, sizes))
        while len(live) and (depth is None or length < depth):
            at = order[live]
            follow = rank[np.minimum(at + length, n)]
            key = rank[at] * np.int64(2 * n + 4) + (follow + n + 2)
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[live] = at
            start = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            sizes = np.diff(start, append=len(key))
            rank[at] = np.repeat(live[start], sizes)
            self.levels.append(self._level(at, rank, sizes, live))
            live, length = live[np.repeat(sizes > 1, sizes)], 2 * length
        self.order = order

    @staticmethod
    def _level(at: np.ndarray, rank: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Positions whose rank is shared at this depth, ascending; their ranks; the places in `order` followed by a place of equal rank."""
        shared = np.sort(at[np.repeat(sizes > 1, sizes)])
        inner = np.ones(len(at), bool)
        inner[np.cumsum(sizes) - 1] = False
        return shared, rank[shared].copy(), place[inner]

    def common(self) -> np.ndarray:
        """For each place of `order`, the number of words its suffix has in common with the one before it (0 at the first)."""
        out = np.zeros(len(self.order), np.int64)
        got, begun = out[1:], np.zeros(0, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            at, rank, equal = self.levels[level]
            if len(at):
                x, y = (_look(at, rank, side[begun] + got[begun]) for side in (self.order[:-1], self.order[1:]))
                got[begun[(x >= 0) & (x == y)]] += 1 << level
                fresh = equal[got[equal] == 0]
                got[fresh] = 1 << level
                begun = np.concatenate([begun, fresh])
        return out

    def longest(self, n: int) -> np.ndarray:
        """For each of `n` positions, the longest prefix of its suffix that occurs elsewhere too."""
        common = self.common()
        out = np.zeros(n, np.int64)
        out[self.order] = np.maximum(common, np.append(common[1:], 0))
        return out


def _look(sorted_at: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of each position, or -1 where its rank is not shared."""
    k = np.minimum(np.searchsorted(sorted_at, at), len(sorted_at) - 1)
    return np.where(sorted_at[k] == at, rank[k], -1)


def covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of `n` places lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + length, -1)
    return np.cumsum(step[:-1]) > 0
