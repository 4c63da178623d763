"""Suffix arrays of byte texts built block by block with a difference cover sample, in numpy.

Positions whose remainder by PERIOD lies in COVER are a sample, whose suffixes are ranked once. For any two positions
there is a step below PERIOD that leads both into the sample, so two suffixes with equal first bytes, however long
they go on alike, are told apart by two ranks. Hence suffixes need not be sorted together: one bucket after the other
is cut out by first bytes, sorted by what it can see and settled by ranks, and only the sample and a bucket are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A difference cover: every number is the difference of two of these modulo the period.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of two suffixes that are compared before their ranks are; at least PERIOD.
SEEN = 16
#: Suffixes that are sorted at once, if they don't all begin with the same two bytes.
BUCKET = 1 << 16

_IN_COVER = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
#: The least step from two remainders into the sample.
STEP = np.array([[next(d for d in range(PERIOD) if _IN_COVER[r + d] and _IN_COVER[s + d]) for s in range(PERIOD)] for r in range(PERIOD)])


def words_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as numbers in their order."""
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view(">u8").ravel().astype(np.uint64)


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class SampleRanks:
    """Ranks of the sample's suffixes in a text, the end of which is smaller than any byte."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.padded = np.concatenate((text, np.zeros(64, np.uint8)))
        sample = np.flatnonzero(_IN_COVER[np.arange(n) % PERIOD])
        self.number = np.full(n + 2 * PERIOD, -1, np.int32)
        self.number[sample] = np.arange(len(sample))
        # The first PERIOD bytes by two overlapping words; of suffixes that end within them the shorter is smaller.
        low, high = words_at(self.padded, sample), words_at(self.padded, sample + PERIOD - 8)
        left = np.minimum(n - sample, PERIOD)
        order = np.lexsort((left, high, low))
        new = np.concatenate(([True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]) | (left[order[1:]] != left[order[:-1]])))[: len(order)]
        rank = _dense(order, new)
        depth = PERIOD
        while len(sample) and rank.max() < len(sample):
            # PERIOD further on lies another position of the sample.
            there = np.minimum(sample + depth, n + PERIOD)
            after = self.number[there]
            key = rank * (len(sample) + 1) + np.where(after >= 0, rank[after], 0)
            order = np.argsort(key, kind="stable")
            rank = _dense(order, np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
            depth *= 2
        self.rank = np.append(rank, 0)

    def at(self, place: np.ndarray) -> np.ndarray:
        """Ranks of these positions of the sample; past the end 0."""
        return self.rank[self.number[place]]


def _settle(ranks: SampleRanks, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes within groups (ascending numbers) whose first SEEN bytes are equal: those of one remainder
    by the rank a fixed step further; then each counts, for each other remainder, the smaller ones of its group."""
    kind = at % PERIOD
    size = len(ranks.rank) + 1
    kinds = [np.flatnonzero(kind == r) for r in range(PERIOD)]
    for r, own in enumerate(kinds):
        key = group[own] * size + ranks.at(at[own] + STEP[r, r])
        kinds[r] = own[np.argsort(key, kind="stable")]
    place = np.searchsorted(group, group)  # where its group begins
    for r, own in enumerate(kinds):
        if len(own):
            place[own] += np.arange(len(own)) - np.searchsorted(group[own], group[own])
            for s, other in enumerate(kinds):
                if s != r and len(other):
                    step = STEP[r, s]
                    theirs = group[other] * size + ranks.at(at[other] + step)
                    mine = group[own] * size + ranks.at(at[own] + step)
                    place[own] += np.searchsorted(theirs, mine) - np.searchsorted(theirs, group[own] * size)
    order = np.empty(len(at), np.int64)
    order[place] = np.arange(len(at))
    return order


def buckets(text: np.ndarray, wanted: np.ndarray, most: int = BUCKET) -> Iterator[np.ndarray]:
    """The wanted suffixes, each at least SEEN bytes long, in their order: bucket after bucket, the largest number of
    beginnings of two bytes that go together within ``most``."""
    if not len(wanted):
        return
    ranks = SampleRanks(text)
    first = text[wanted].astype(np.int64) << 8 | text[wanted + 1]
    ends = np.cumsum(np.bincount(first, minlength=1 << 16))
    a = 0
    while a < len(ends):
        below = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, below + most, side="right")))
        if ends[b - 1] > below:
            yield _sorted(ranks, wanted[(first >= a) & (first < b)])
        a = b


def _sorted(ranks: SampleRanks, at: np.ndarray) -> np.ndarray:
    low, high = words_at(ranks.padded, at), words_at(ranks.padded, at + 8)
    order = np.lexsort((high, low))
    at, low, high = at[order], low[order], high[order]
    same = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
    tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
    if tied.any():
        group = np.cumsum(np.concatenate(([True], ~same)))[tied]
        at[tied] = at[tied][_settle(ranks, at[tied], group)]
    return at


def equal_runs(text: np.ndarray, wanted: np.ndarray, length: int, most: int = BUCKET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket: its suffixes in order and whether each shares its first ``length`` bytes with the one before."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(8, np.uint8))), 8)
    steps = [*range(0, length - 7, 8), length - 8]
    for at in buckets(text, wanted, most):
        same = np.ones(len(at) - 1, bool)
        for step in steps:
            left = np.flatnonzero(same)
            part = view[at + step].view(np.uint64).ravel() if len(left) > len(at) // 2 else None
            if part is not None:
                same &= part[1:] == part[:-1]
            else:
                same[left] = view[at[left + 1] + step].view(np.uint64).ravel() == view[at[left] + step].view(np.uint64).ravel()
        yield at, np.concatenate(([False], same))
