"""An FM-index over integer symbols: a wavelet matrix of the Burrows-Wheeler transform, searched backwards in lockstep.

Suffixes are sorted by their first ``depth`` symbols, equal ones by position; that is all that patterns of at most ``depth``
symbols need, and makes a pattern's earliest occurrence the first of its interval. Matching statistics are cut off at ``depth``.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.levels.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each position stands in the order of the last level, for its symbol."""
        for level, (rank, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = rank.ones(at)
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + one, at - one)
        return at


class FMIndex:
    """The order of suffixes isn't kept: of each run of rows with the same ``depth`` symbols the first position (the earliest), and
    where the runs with one symbol less begin; both found by rank over a bit vector."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        """text: symbols from 0; 0 ends a sequence and is in no pattern."""
        self.depth, n = depth, len(text)
        self.sigma = int(text.max()) + 1 if n else 1
        rank, width = text.astype(np.int64), 1
        while 2 * width <= depth:
            rank, width = self._pair(rank, width), 2 * width
        order = self._order(rank, depth - width) if depth > width else np.argsort(rank, kind="stable")
        # rows that begin as the row before does
        whole = self._pairs_equal(rank, order, depth - width)
        less = self._pairs_equal(rank, order, depth - 1 - width) if depth - 1 >= width else np.zeros(n, bool)
        self.runs, self.earliest = BitRank(~whole), order[~whole].astype(np.int32)
        self.groups, self.starts = BitRank(~less), np.append(np.flatnonzero(~less), n).astype(np.int32)
        bwt = text[order - 1]
        self.tree = WaveletMatrix(bwt, max(1, int(self.sigma - 1).bit_length()))
        symbols = np.arange(self.sigma)
        self.base = self.tree.descend(symbols, np.zeros(self.sigma, np.int64))
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))]).astype(np.int64)
        self.size = n

    def position(self, row: np.ndarray) -> np.ndarray:
        """The earliest position of the symbols that a row begins with."""
        return self.earliest[self.runs.ones(row + 1) - 1].astype(np.int64)

    def shorter(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the rows that begin as this one does, but for the last symbol."""
        group = self.groups.ones(row + 1) - 1
        return self.starts[group].astype(np.int64), self.starts[group + 1].astype(np.int64)

    def _shift(self, rank: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([rank[by:] + 1, np.zeros(by, np.int64)]) if by else rank + 1

    def _pair(self, rank: np.ndarray, by: int) -> np.ndarray:
        key = rank * (int(rank.max()) + 2) + self._shift(rank, by) if len(rank) else rank
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    def _order(self, rank: np.ndarray, by: int) -> np.ndarray:
        return np.argsort(rank * (int(rank.max()) + 2) + self._shift(rank, by), kind="stable") if len(rank) else rank

    def _pairs_equal(self, rank: np.ndarray, order: np.ndarray, by: int) -> np.ndarray:
        a, b = rank[order], self._shift(rank, by)[order]
        return np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])]) if len(rank) else np.zeros(0, bool)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before them."""
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) - np.concatenate([self.base[symbol]] * 2)
        return self.count[symbol] + both[: len(lo)], self.count[symbol] + both[len(lo) :]

    def matching_statistics(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of one sequence: the length, up to depth, of the longest match that starts there, and the
        first position of the text where it occurs (-1 for none). Symbols that the text lacks are -1."""
        n = len(query)
        length, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for k in range(1, self.depth + 1):  # all patterns of k symbols at once
            live = np.flatnonzero(length[: max(0, n - k + 1)] == k - 1)
            lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
            for j in range(k - 1, -1, -1):
                symbol = query[live + j]
                known = (symbol > 0) & (symbol < self.sigma) & (lo < hi)
                live, lo, hi, symbol = live[known], lo[known], hi[known], symbol[known]
                lo, hi = self.step(symbol, lo, hi)
            hit = lo < hi
            length[live[hit]] = k
            if k == self.depth:
                where[live[hit]] = self.position(lo[hit])
        return length, where

    def first_occurrences(self, text: np.ndarray, last: np.ndarray, windows: np.ndarray):
        """Streams sequences from their ends: for every window of depth symbols the start of its first occurrence.

        last: the start of each sequence's last window, windows: how many it has. Yields (starts, first occurrences);
        where a window doesn't occur the latter is -1, and the next one is searched from its own end.
        """
        lo, hi = np.zeros(len(last), np.int64), np.full(len(last), self.size, np.int64)
        fresh = np.arange(len(last))
        live, at = np.arange(len(last)), last.astype(np.int64)
        back = 0
        while len(live):
            if len(fresh):  # whole patterns
                l, h = np.zeros(len(fresh), np.int64), np.full(len(fresh), self.size, np.int64)
                for j in range(self.depth - 1, -1, -1):
                    symbol = text[at[fresh] + j]
                    l, h = self.step(symbol, l, h)
                    h = np.maximum(l, h)
                lo[fresh], hi[fresh] = l, h
            hit = lo < hi
            yield at, np.where(hit, self.position(np.minimum(lo, self.size - 1)), -1)
            back += 1
            on = windows[live] > back
            live, at, lo, hi, hit = live[on], at[on] - 1, lo[on], hi[on], hit[on]
            # drop the last symbol, put one before
            l, h = (np.where(hit, x, 0) for x in self.shorter(np.minimum(lo, max(0, self.size - 1))))
            if len(live):
                lo, hi = self.step(text[at], l, h)
            fresh = np.flatnonzero(~hit)
