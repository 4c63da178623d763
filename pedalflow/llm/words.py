"""Words, their 64-bit hashes and hashes of word sequences, computed with numpy over whole Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))))


_POW = _powers(0x2545F4914F6CDD1D, 1 << 12)
_SEQ = _powers(0xD1342543DE82EF95, 64)


@dataclass
class Words:
    """Of some documents: the text bytes, each word's start and end in them, its hash, and where each document's
    words begin (one entry more than documents)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of documents of about so many bytes."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(raw: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    """The words of the documents between these offsets."""
    base = int(offs[0])
    data = raw[base : int(offs[-1])]
    if lower:
        data = LOWER[data]
    rel = offs - base
    n = len(data)
    inside = _INSIDE[data]
    edge = np.zeros(n + 1, bool)
    edge[rel] = True
    start = inside.copy()
    end = inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    offsets = np.searchsorted(starts, rel)
    length = ends - starts
    if len(starts) == 0:
        return Words(data, starts, ends, np.zeros(0, np.uint64), offsets)
    count = int(length.sum())
    first = np.repeat(np.cumsum(length) - length, length)
    within = np.arange(count) - first
    with np.errstate(over="ignore"):
        terms = _BYTE[data[inside]] * _POW[within & 4095]
        far = within > 4095  # the powers repeat there; nothing else of the slice may change
        if far.any():
            terms[far] = mix(terms[far] + (within[far] >> 12).astype(np.uint64) * _GOLD)
        sums = np.add.reduceat(terms, np.cumsum(length) - length)
        hashes = mix(sums + length.astype(np.uint64) * _GOLD)
    return Words(data, starts, ends, hashes, offsets)


def compact_words(raw: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of the documents between these offsets as one string array, and where each document's begin."""
    data = raw[int(offs[0]) : int(offs[-1])]
    rel = offs - int(offs[0])
    inside = _INSIDE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[rel] = True
    start = inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(start)
    kept = data[inside]
    if lower:
        kept = LOWER[kept]
    before = np.concatenate(([0], np.cumsum(inside)))
    bounds = np.append(before[starts], len(kept))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(kept))
    return words, np.searchsorted(starts, rel)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of n words of one document, and where each document's runs begin."""
    h, offs = words.hashes, words.offsets
    counts = np.maximum(np.diff(offs) - n + 1, 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    if begins[-1] == 0:
        return np.zeros(0, np.uint64), begins
    total = len(h) - n + 1
    with np.errstate(over="ignore"):
        acc = h[:total] * _SEQ[0]
        for k in range(1, n):
            acc = acc + h[k : k + total] * _SEQ[k]
        acc = mix(acc + np.uint64(n) * _GOLD)
    keep = np.arange(begins[-1]) - np.repeat(begins[:-1], counts) + np.repeat(offs[:-1], counts)
    return acc[keep], begins


def pieces(batch: pa.RecordBatch, column: str = "text", lower: bool = False, most: int = SLICE_BYTES):
    """For slices of a batch: first row, last row (open), and the words of those rows' texts."""
    raw, offs = text_buffers(batch.column(column))
    for i, j in slices(offs, most):
        yield i, j, split(raw, offs[i : j + 1], lower)
