"""A compressed FM-index over sequences of words, with numpy.

The text is a run of segments. Suffixes are sorted by their first 64 symbols,
which is all that patterns of up to 63 need. The transform of that order is held
in a wavelet matrix of packed bits with counts per 64, so a symbol costs its bits
and half as much again. Patterns are searched backwards, many at a time.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64
_ONE = np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols in a sequence, from packed bits level by level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, dtype=bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(size)
        self.start = self._down(np.zeros(size, dtype=np.int64), every)

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = self.words[k][word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE)
            ones = self.counts[k][word] + np.bitwise_count(below)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(at, symbol) - self.start[symbol]


def _next(rank: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros_like(rank)
    out[: len(rank) - step] = rank[step:] if step < len(rank) else rank[:0]
    return out


class FMIndex:
    """The index of a text of symbols 1 and above, for windows of a fixed length.

    ``owner`` names the document of each place. Of all places that begin with the
    same window the smallest owner is kept, in one number per such group.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, window: int, size: int):
        if not 32 <= window <= DEPTH - 1:
            raise ValueError("windows of 32 to 63 words")
        n, self.window = len(text), window
        rank = text.astype(np.int64)
        step = 1
        while True:
            pair = rank * (int(rank.max(initial=0)) + 2) + _next(rank, step)
            order = np.argsort(pair, kind="stable")
            if step == DEPTH // 2:
                break
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.cumsum(np.r_[True, pair[order][1:] != pair[order][:-1]])
            rank, step = fresh, 2 * step
        # ``rank`` now tells the first 32 symbols apart: twice 32 overlapping make a window.
        self.n = n
        self.left, self.right = self._groups(rank, order, window - 1)
        first, _ = self._groups(rank, order, window)
        opens = np.flatnonzero(first == np.arange(n))
        self.group = np.cumsum(first == np.arange(n)) - 1
        self.least = np.minimum.reduceat(owner[order], opens)
        before = text[order - 1]  # of the first symbol its last
        self.bwt = WaveletMatrix(before, size)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def _groups(self, rank: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first and the end of the rows that share so many symbols."""
        far = _next(rank, length - 32)
        a, b = rank[order], far[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        number = np.cumsum(new) - 1
        opens = np.flatnonzero(new)
        ends = np.r_[opens[1:], len(order)]
        return opens[number], ends[number]

    def statistics(self, patterns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each window of each pattern the smallest owner of a place that begins with it.

        ``patterns`` has a row per pattern, padded at the end, and each pattern lies
        in the text. All are read from right to left together: one backward step a
        word; a match of full length first gives up its last word.
        """
        rows, width = patterns.shape
        out = np.full((rows, max(0, width - self.window + 1)), np.iinfo(np.int64).max)
        low, high = np.zeros(rows, dtype=np.int64), np.full(rows, self.n, dtype=np.int64)
        length = np.zeros(rows, dtype=np.int64)
        for at in range(width - 1, -1, -1):
            live = np.flatnonzero(at < sizes)
            if not len(live):
                continue
            symbol, a, b, m = patterns[live, at], low[live], high[live], length[live]
            full = m == self.window
            row = np.where(full, a, 0)
            a, b = np.where(full, self.left[row], a), np.where(full, self.right[row], b)
            start = self.below[symbol]
            a, b = start + self.bwt.rank(symbol, a), start + self.bwt.rank(symbol, b)
            m = m - full + 1
            low[live], high[live], length[live] = a, b, m
            done = m == self.window
            if done.any():
                out[live[done], at] = self.least[self.group[a[done]]]
        return out
