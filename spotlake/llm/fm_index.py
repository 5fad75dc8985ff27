"""A compressed FM-index over fragments of words, in numpy: suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol before a position, by one packed bit vector with block counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = range(max(1, int(top).bit_length()) - 1, -1, -1)
        self.words, self.blocks, self.zeros = [], [], []
        now = symbols
        for level in self.levels:
            bits = (now >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(now) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.start = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for words, blocks, zeros, level in zip(self.words, self.blocks, self.zeros, self.levels, strict=True):
            block = at >> 6
            ones = blocks[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Fragments (lists of word numbers from 1) end to end, each closed by 0.

    Suffixes are ordered by more than their first ``depth`` symbols (at least 2), which is enough for such patterns.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        rank, span = text.astype(np.int64), 1
        part = 1 << ((depth - 1).bit_length() - 1)  # the largest power of two below the depth
        of_part = rank if part == 1 else None
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - span] = rank[span:] + 1 if span < n else 0
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            span *= 2
            if span == part:
                of_part = rank
            if span > depth:
                break
        self.order = order
        # Where neighbours in suffix order differ within depth - 1 and within depth symbols.
        pad = np.concatenate([of_part, np.full(depth, -1, np.int64)])
        same = of_part[order[1:]] == of_part[order[:-1]]
        less, full = (same & (pad[order[1:] + d - part] == pad[order[:-1] + d - part]) for d in (depth - 1, depth))
        ends = np.concatenate([~less, [True]])
        self.low = np.maximum.accumulate(np.where(np.concatenate([[True], ~less]), np.arange(n), 0))
        self.high = np.minimum.accumulate(np.where(ends, np.arange(1, n + 1), n)[::-1])[::-1]
        self.begins = np.flatnonzero(np.concatenate([[True], ~full]))
        self.group = np.cumsum(np.concatenate([[True], ~full])) - 1
        top = int(text.max()) if n else 0
        self.matrix = WaveletMatrix(text[order - 1], top)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffixes that begin with the symbol and go on as those of the interval."""
        r = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.count[symbol]
        return base + r[: len(symbol)], base + r[len(symbol) :]

    def statistics(self, text: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """Stream fragments of ``text`` from right to left, all at once.

        Yields (fragment, window's first position, interval) for every window of ``depth`` symbols that
        occurs. The matching statistic is held at ``depth``: after each match the last symbol is dropped by
        going to the enclosing interval of depth - 1.
        """
        n = len(self.order)
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), n, np.int64)
        depth = np.zeros(len(begin), np.int64)
        longest = int(length.max()) if len(length) else 0
        for back in range(longest):
            live = np.flatnonzero(length > back)
            at = begin[live] + length[live] - 1 - back
            lo, hi, d = low[live], high[live], depth[live]
            full = d == self.depth
            lo, hi, d = np.where(full, self.low[np.minimum(lo, n - 1)], lo), np.where(full, self.high[np.minimum(lo, n - 1)], hi), np.where(full, d - 1, d)
            lo, hi = self.extend(text[at], lo, hi)
            gone = lo >= hi
            lo, hi, d = np.where(gone, 0, lo), np.where(gone, n, hi), np.where(gone, 0, d + 1)
            low[live], high[live], depth[live] = lo, hi, d
            hit = d == self.depth
            if hit.any():
                yield live[hit], at[hit], lo[hit], hi[hit]
