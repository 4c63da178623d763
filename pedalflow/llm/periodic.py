"""Periodic runs of words in documents: repeated k-gram masking, then Main-Lorentz on the segments that survive.

A run has period q, at least LEAST words and at least TIMES periods, so its words but the last q come again q words
later. That overlap has OVERLAP words at least, whatever q is, and every word of the run lies in it or in its repeat:
a word outside every OVERLAP-gram that its document holds twice can't be in a run. What remains falls into segments.
Each is halved again and again; a run lies in the topmost half-open part whose middle it crosses, on one side of which
it has two periods or more, so that equal neighbouring blocks at the middle name its period and two longest common
extensions its ends. Blocks are compared by names of their powers of two (prefix doubling), for all periods of all parts of one depth at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, lean, others, prepare, read
from .words import compact_words, mix, slices, text_buffers

#: A run has so many words and so many periods at least.
LEAST, TIMES = 6, 4
#: The least number of words that a run shares with itself, shifted by its period.
OVERLAP = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def survivors(codes: np.ndarray, offsets: np.ndarray, k: int = OVERLAP) -> np.ndarray:
    """Whether each word lies in a run of k words that its document holds twice. A hash that two of them share by
    accident lets a few words more survive."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    change = np.zeros(len(codes) + 1, np.int64)
    if not counts.sum():
        return change[:-1] > 0
    at = _within(counts) + np.repeat(offsets[:-1], counts)
    with np.errstate(over="ignore"):
        values = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        sums = mix(np.repeat(np.arange(1, len(counts) + 1, dtype=np.uint64), counts))
        for j in range(k):
            sums = sums * np.uint64(0xD1342543DE82EF95) + values[at + j]
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    change[: len(codes)] += np.bincount(at[again], minlength=len(codes))
    change[k:] -= np.bincount(at[again], minlength=len(codes))[: len(change) - k]
    return np.cumsum(change)[:-1] > 0


class Blocks:
    """Names of all blocks of 1, 2, 4, ... symbols of a text: equal blocks have equal names."""

    def __init__(self, text: np.ndarray, longest: int):
        names = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.n, tables = len(text), [names]
        while 2 << (len(tables) - 1) <= longest:
            half = 1 << (len(tables) - 1)
            pairs = names[: len(names) - half] * (int(names.max()) + 1) + names[half:]
            names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            tables.append(names)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in tables])))[:-1]
        self.levels = len(tables)
        self.flat = np.concatenate([t.astype(np.int32) for t in tables])

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the blocks of this length at i and j, both inside the text, are equal."""
        level = np.frexp(length.astype(np.float64))[1] - 1
        base, rest = self.begin[level], length - (1 << level)
        return (self.flat[base + i] == self.flat[base + j]) & (self.flat[base + i + rest] == self.flat[base + j + rest])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on, for i < j."""
        total = np.zeros(len(i), np.int64)
        for level in range(self.levels - 1, -1, -1):
            inside = np.flatnonzero(j + total + (1 << level) <= self.n)
            a, b = (i + total)[inside] + self.begin[level], (j + total)[inside] + self.begin[level]
            total[inside[self.flat[a] == self.flat[b]]] += 1 << level
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j, for i < j."""
        total = np.zeros(len(i), np.int64)
        for level in range(self.levels - 1, -1, -1):
            inside = np.flatnonzero(i - total >= 1 << level)
            a, b = ((x - total)[inside] - (1 << level) + self.begin[level] for x in (i, j))
            total[inside[self.flat[a] == self.flat[b]]] += 1 << level
        return total


def main_lorentz(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of the runs in these segments of a text, by start and period. What follows a
    segment must be a symbol that nothing else in the text equals."""
    none = np.zeros(0, np.int64)
    if not len(lo):
        return none, none, none
    blocks = Blocks(text, int((hi - lo).max()))
    found = []
    while len(lo):
        middle, most = (lo + hi) // 2, (hi - lo) // TIMES
        q, mid = _within(most) + 1, np.repeat(middle, most)
        for i in (mid, mid - 2 * q):  # two equal blocks behind the middle, or before it
            hit = np.flatnonzero(blocks.equal(i, i + q, q))
            a, period = i[hit], q[hit]
            start, end = a - blocks.behind(a, a + period), a + period + blocks.ahead(a, a + period)
            keep = end - start >= np.maximum(LEAST, TIMES * period)
            found.append(np.stack((start, end, period))[:, keep])
        lo, hi = np.concatenate((lo, middle)), np.concatenate((middle, hi))
        long = hi - lo >= LEAST
        lo, hi = lo[long], hi[long]
    start, end, period = np.concatenate(found, axis=1)
    # A stretch that has a period has its multiples too; its smallest is among them.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(start) else np.zeros(0, bool)
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (place among all these words), end and period of every run of these documents, by start and period."""
    left = survivors(codes, offsets)
    edges = np.zeros(len(codes) + 1, bool)
    edges[offsets] = True
    begin = np.flatnonzero(left & (edges[:-1] | ~np.concatenate(([False], left[:-1]))))
    close = np.flatnonzero(left & (edges[1:] | ~np.concatenate((left[1:], [False])))) + 1
    long = close - begin >= LEAST
    begin, close = begin[long], close[long]
    size = close - begin
    # Segments end to end, each followed by a symbol of its own.
    lo = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    place = np.repeat(lo, size) + _within(size)
    text[place] = codes[np.repeat(begin, size) + _within(size)]
    text[lo + size] = -1 - np.arange(len(size))
    start, end, period = main_lorentz(text, lo, lo + size)
    shift = (begin - lo)[np.searchsorted(lo, start, side="right") - 1] if len(start) else np.zeros(0, np.int64)
    return start + shift, end + shift, period


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = text_buffers(batch.column("text"))
        for i, j in slices(offs):
            words, offsets = compact_words(raw, offs[i : j + 1])
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
            start, end, period = runs_of(codes, offsets)
            doc = np.searchsorted(offsets, start, side="right") - 1
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            kept = np.flatnonzero(np.cumsum(change)[:-1] <= 0)
            bounds = np.searchsorted(kept, offsets)
            texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words.take(pa.array(kept))), pa.scalar(" ", pa.large_string()))
            runs = pa.StructArray.from_arrays([pa.array(start - offsets[doc]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(np.diff(offsets)), lists, texts.cast(pa.string())], names=["row", "n_words", "runs", "kept"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The columns of docs but ``text``, in a struct ``row``; ``n_words``; ``runs``, an array of (start, length, period)
    by start and period, in words numbered from 0; and ``kept``: the words that no run holds after its first period,
    joined by one space.

    Null texts are empty and have no runs; so have texts of fewer than LEAST words. Repeated rows are handled one by
    one, each with the same result. Of periods that a stretch has, it gets the smallest. Words are compared as they
    are, not by hashes. A text of any length is one record: its surviving words take 4 bytes for each power of two up
    to its longest segment. Columns of any name pass in ``row``. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in others(docs.columns, "text")]
    ready = docs.select(F.struct(*rest, F.lit(None).cast("int").alias("_")).alias("row") if not rest else F.struct(*rest).alias("row"), "text")
    schema = T.StructType([ready.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("kept", T.StringType())])
    return ready.mapInArrow(lean(_find), schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of every tenth crc32 of the id repeats one stretch of its words to its end."""
    n = F.size("w")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.slice("w", a + 1, p)
    words = F.slice(F.concat(F.slice("w", F.lit(1), a), F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int")))), F.lit(1), n)
    chosen = docs.select("doc_id", "text", F.when(crc % 10 == 0, F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)")).alias("w"))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents").select("doc_id", "text")))
    # Strictly greater keeps the first of equal ones.
    most = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    best = found.withColumn("best", most)
    return best.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
