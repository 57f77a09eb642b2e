"""A compressed FM-index over short texts of words, searched for many windows at once.

The texts of a shard are laid one after the other, ended by a mark each, and
sorted by their first words. The column of words that stand before the sorted
suffixes (the Burrows-Wheeler transform) is kept as a wavelet matrix: one bit a
word and level, with counts every 64 bits. Backward search extends a window to
the left by two ranks a level; all windows of a shard take the step together.
"""

from __future__ import annotations

import numpy as np

#: Windows that are extended together: their places stay in the processor's cache.
WINDOWS_AT_ONCE = 1 << 13
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8))
        self.word = packed.view(np.uint64)
        ones = np.bitwise_count(self.word).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        return self.before.take(block) + np.bitwise_count(self.word.take(block) & _BELOW.take(at & 63))


class Wavelet:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, bits: int, n_symbols: int):
        self.bits = bits
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(Bits(bit.astype(bool)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        # Where each symbol's run begins on the last level: the same for all ranks.
        every = np.arange(n_symbols)
        self.begin = self._down(every, np.zeros((1, n_symbols), np.int64))[0]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places (one row or more for each symbol) followed to the last level."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = level.ones(at)
            at = np.where(bit, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Occurrences of each symbol before ``low`` and before ``high``."""
        low, high = self._down(symbol, np.stack([low, high]))
        begin = self.begin.take(symbol)
        return low - begin, high - begin


class FmIndex:
    """Index of texts given as runs of word numbers from 1 on; 0 ends each text.

    Suffixes are told apart by their first ``depth`` words, which is enough for
    windows of up to that many.
    """

    def __init__(self, words: np.ndarray, n_words: int, depth: int):
        n = len(words)
        rank = words.astype(np.int64)
        step = 1
        while step < depth:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if n > step else 0
            key = rank * (int(rank.max(initial=0)) + 2) + after
            # Equal keys get equal ranks, in the order of the keys.
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        before = words[self.order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=n_words + 1))])
        self.n = n
        self.wavelet = Wavelet(before.astype(np.int64), max(1, int(n_words).bit_length()), n_words + 1)

    def search(self, texts: np.ndarray, ends: np.ndarray, length: int):
        """Interval of the sorted suffixes that begin with each window, and its match length.

        A window is the ``length`` words before a place in ``ends``. The match
        length is how many words from the window's end occur together in the
        index: the matching statistic of that place, cut at ``length``.
        """
        parts = [
            self._search(texts, ends[at : at + WINDOWS_AT_ONCE], length)
            for at in range(0, max(1, len(ends)), WINDOWS_AT_ONCE)
        ]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _search(self, texts: np.ndarray, ends: np.ndarray, length: int):
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), self.n, np.int64)
        matched = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(1, length + 1):
            symbol = texts[ends[live] - k].astype(np.int64)
            a, b = self.first[symbol], self.first[symbol + 1]
            if k > 1:
                # Of the whole column, all occurrences of a word are its interval.
                before, until = self.wavelet.rank(symbol, low[live], high[live])
                a, b = a + before, a + until
            some = a < b
            live = live[some]
            low[live], high[live] = a[some], b[some]
            matched[live] = k
        return low, high, matched
