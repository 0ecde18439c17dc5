"""Compressed FM-index of word sequences: a Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with counts per 64 bits, for the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.packed = np.packbits(padded.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed))]).astype(np.int64)
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.packed[word] & mask)


class WaveletMatrix:
    """A sequence of numbers below ``2^levels``, one bit vector per level."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.bits = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        symbols = np.arange(largest + 1)
        self.first = self._walk(symbols, np.zeros(largest + 1, np.int64))

    def _walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.bits):
            ones = bits.rank(i)
            i = np.where((symbols >> (self.levels - 1 - k)) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place ``i``."""
        return self._walk(symbols, i) - self.first[symbols]


class FMIndex:
    """Index of passages of numbers from 1 up, for patterns up to 63 numbers.

    Suffixes are sorted by their first 64 numbers, by doubling the sorted length. Backward search stays exact for
    shorter patterns, because suffixes that differ later keep their order when a number is put in front.
    """

    _DEPTH = 64

    def __init__(self, passages: list[np.ndarray], owners: np.ndarray, window: int):
        if not 1 < window < self._DEPTH:
            raise ValueError("a window has 2 to 63 words")
        self.window = window
        sizes = np.array([len(p) + 1 for p in passages])
        self.starts = np.cumsum(sizes) - sizes
        text = np.concatenate([x for p in passages for x in (p, [0])]).astype(np.int64)
        self.text = text
        ranks, order = self._sorted(text)
        del ranks
        self.order = order
        last = text[order - 1]  # the number before each suffix, the text taken as a ring
        largest = int(text.max())
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.matrix = WaveletMatrix(last, largest)
        # Ranges of suffixes that share ``window - 1`` numbers, and per range of ``window`` the smallest owner.
        n = len(text)
        short = self._ranges(window - 1)
        self.low, self.high = short[:-1], short[1:]
        self.short_of = np.repeat(np.arange(len(self.low)), np.diff(short))
        full = self._ranges(window)
        owner = np.repeat(owners, sizes)[order]
        self.least_owner = np.minimum.reduceat(owner, full[:-1])
        self.full_of = np.repeat(np.arange(len(full) - 1), np.diff(full))
        self.size = n

    def _sorted(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        _, ranks = np.unique(text, return_inverse=True)
        self.rank_of = {1: ranks}
        step = 1
        order = np.arange(n)
        while step < self._DEPTH:
            after = np.concatenate([ranks[step:], ranks[:step]])
            key = ranks * (ranks.max() + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[0] = 0
            new[1:] = key[order[1:]] != key[order[:-1]]
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(new)
            step *= 2
            if step == self._DEPTH // 2:
                self.rank_of = {step: ranks}
        return ranks, order

    def _ranges(self, length: int) -> np.ndarray:
        """Bounds of the ranges of sorted suffixes that share their first ``length`` numbers."""
        half = self._DEPTH // 2
        ranks = self.rank_of[half]
        order, n = self.order, len(self.order)
        if length >= half:
            pair = ranks[order] * (ranks.max() + 1) + ranks[(order + length - half) % n]
            new = pair[1:] != pair[:-1]
        else:
            places = (order[:, None] + np.arange(length)) % n
            new = (self.text[places[1:]] != self.text[places[:-1]]).any(axis=1)
        return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])

    def least_owners(self, passages: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each passage the smallest owner of an equal window in the index.

        Matching statistics by backward search: from the last word to the first, the range of suffixes that start
        with the words read; a word that is not there empties the range. Once the match has ``window`` words it is
        reported and cut back to ``window - 1`` on its right. A window that is nowhere gets the largest number.
        All passages are read at once, one word of each per step.
        """
        none = np.iinfo(np.int64).max
        sizes = np.array([len(p) for p in passages])
        by = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)
        flat = np.concatenate([*passages, np.zeros(0, np.int64)]).astype(np.int64)
        out = np.full(len(flat), none)
        low, high = np.zeros(len(by), np.int64), np.full(len(by), self.size)
        length = np.zeros(len(by), np.int64)
        known = len(self.below) - 1
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes[by], -step, side="left"))
            at = ends[by[:live]] - 1 - step
            c = flat[at]
            there = c < known
            symbol = np.where(there, c, 0)
            a = self.below[symbol] + self.matrix.rank(symbol, low[:live])
            b = self.below[symbol] + self.matrix.rank(symbol, high[:live])
            hit = there & (a < b)
            low[:live] = np.where(hit, a, 0)
            high[:live] = np.where(hit, b, self.size)
            length[:live] = np.where(hit, length[:live] + 1, 0)
            full = np.flatnonzero(length[:live] == self.window)
            if len(full):
                out[at[full]] = self.least_owner[self.full_of[low[full]]]
                short = self.short_of[low[full]]
                low[full], high[full] = self.low[short], self.high[short]
                length[full] = self.window - 1
        firsts = ends - sizes
        return [out[f : f + max(0, s - self.window + 1)] for f, s in zip(firsts, sizes)]
