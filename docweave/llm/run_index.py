"""A run-length index of a collection of short texts: Burrows-Wheeler runs with samples at the run heads.

Neighbouring suffixes that follow the same byte come from neighbouring suffixes one place further on, so only the first
row of a run of the transform needs its match length with the row above measured. In text order every other length is
one less than the one before; matching statistics are streamed from the samples.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # symbols in the first sort key


class RunIndex:
    """Index of ``texts`` (bytes of one after another, ``ends`` their bounds; each at most ``longest`` bytes)."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, longest: int):
        sizes = np.diff(ends)
        text = np.repeat(np.arange(len(sizes)), sizes)
        #: Places in the symbols: every text is followed by an end, 0; bytes count from 1.
        self.start = ends[:-1] + np.arange(len(sizes))
        self.symbols = np.zeros(len(raw) + len(sizes), dtype=np.int16)
        self.symbols[np.arange(len(raw)) + text] = raw.astype(np.int16) + 1
        n = len(self.symbols)
        stop = np.repeat(self.start + sizes, sizes + 1)
        #: Symbols from each place to the end of its text.
        self.left = stop - np.arange(n)
        self.levels: list[tuple[int, np.ndarray]] = []
        self.order = self._sort(longest)
        before = self.symbols[self.order - 1]
        before[self.order == 0] = 0
        head = np.ones(n, dtype=bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(head)
        self.run_symbols = before[self.heads]
        self.samples = self.order[self.heads]
        self.lengths = self._common(self.samples, self.order[self.heads - 1])
        self.lengths[0] = 0

    def _sort(self, longest: int) -> np.ndarray:
        """Suffixes in order by doubling; equal ones, up to the ends of their texts, in the order of the texts."""
        n = len(self.symbols)
        padded = np.concatenate([self.symbols.astype(np.int64), np.zeros(FIRST, dtype=np.int64)])
        key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(FIRST):
            symbol = np.where(alive, padded[k: k + n], 0)
            alive &= symbol > 0
            key = key * 257 + symbol
        size = FIRST
        while True:
            last = size > longest
            order = np.argsort(key, kind="stable" if last else "quicksort")
            if last:
                return order
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.cumsum(np.concatenate([[False], np.diff(key[order]) != 0]), dtype=np.int32)
            self.levels.append((size, rank))
            key = rank.astype(np.int64) * (n + 1)
            near = max(0, n - size)
            key[:near] += np.where(self.left[:near] > size, rank[size:].astype(np.int64) + 1, 0)
            size *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at ``a`` and ``b``."""
        n, most = len(self.symbols), np.minimum(self.left[a], self.left[b])
        done = np.zeros(len(a), dtype=np.int64)
        for size, rank in reversed(self.levels):
            same = rank[np.minimum(a + done, n - 1)] == rank[np.minimum(b + done, n - 1)]
            done += np.where(same & (done < most), size, 0)
        for _ in range(FIRST - 1):
            same = self.symbols[np.minimum(a + done, n - 1)] == self.symbols[np.minimum(b + done, n - 1)]
            done += same & (done < most)
        return np.minimum(done, most)

    def match_lengths(self) -> np.ndarray:
        """For every place the length that its suffix has in common with the one before it in order."""
        n = len(self.symbols)
        sampled = np.zeros(n, dtype=np.int64)
        sampled[self.samples] = self.lengths
        at = np.full(n, -1, dtype=np.int64)
        at[self.samples] = self.samples
        source = np.maximum.accumulate(at)
        return sampled[source] - (np.arange(n) - source)

    def seen_before(self, length: int) -> np.ndarray:
        """For every place whether its next ``length`` bytes are also in an earlier text, or earlier in its own."""
        matched = self.match_lengths()[self.order] >= length
        begins = np.flatnonzero(~matched)
        earliest = np.repeat(np.minimum.reduceat(self.order, begins), np.diff(np.concatenate([begins, [len(self.order)]])))
        seen = np.zeros(len(self.order), dtype=bool)
        seen[self.order] = earliest < self.order
        return seen
