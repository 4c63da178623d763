"""An FM-index over word symbols with a wavelet matrix, built and searched with numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed words and the ones before each of them."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FmIndex:
    """Counts and intervals of patterns of up to DEPTH symbols in a text of numbers (0 parts its pieces).

    Suffixes are sorted by their first DEPTH symbols only, which is as far as a backward search of such patterns
    looks: a pattern's suffixes are side by side, and a step to the left counts its symbol in the Burrows-Wheeler
    transform before both ends. The transform lies in a wavelet matrix, as many bits a symbol as the alphabet takes;
    neither the text nor the suffix array is kept. An interval names what it was found for: places of a stream that
    come back with the same one hold the same symbols.
    """

    DEPTH = 16

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        order = np.argsort(rank, kind="stable")
        while step < self.DEPTH:
            # Past the end lies what is smaller than any symbol.
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable" if step == 1 else None)
            ordered = key[order]
            fresh = np.concatenate(([False], ordered[1:] != ordered[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            step *= 2
        last = text[order - 1]  # the place before the first is the last, where a piece ends
        counts = np.bincount(text, minlength=int(text.max()) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.levels = max(1, int(text.max()).bit_length())
        self.planes: list[Bits] = []
        row = last
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.planes.append(Bits(bit))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.origin = self._descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, plane in zip(reversed(range(self.levels)), self.planes, strict=True):
            ones = plane.ones(at)
            at = np.where((symbols >> level) & 1, plane.zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol more on the left."""
        base = self.first[symbols] - self.origin[symbols]
        both = self._descend(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        return base + both[: len(low)], base + both[len(low) :]

    def matching(self, stream: np.ndarray, limit: int = DEPTH, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a stream: for each place, how many symbols that end there, up to ``limit``, lie side
        by side at ``least`` places of the text, and the interval of that match. Symbols that the text lacks, and 0,
        match nothing.

        All places search backward together, one symbol a step; those whose interval gets too small drop out.
        """
        length, low, high = (np.zeros(len(stream), np.int64) for _ in range(3))
        known = (stream > 0) & (stream < len(self.first) - 1)
        at = np.flatnonzero(known)
        a, b = self.first[stream[at]], self.first[stream[at] + 1]
        for size in range(1, limit + 1):
            keep = b - a >= least
            at, a, b = at[keep], a[keep], b[keep]
            length[at], low[at], high[at] = size, a, b
            if size == limit or not len(at):
                break
            go = (at >= size) & known[at - size]
            at, a, b = at[go], a[go], b[go]
            a, b = self.extend(stream[at - size], a, b)
        return length, low, high
