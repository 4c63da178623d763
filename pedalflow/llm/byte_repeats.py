"""Removing byte strings that repeat across documents, found with blockwise suffix arrays of shards.

A window is WINDOW consecutive bytes. The smallest hash of its runs of GRAM bytes is its anchor, so equal windows have
equal anchors and only windows whose anchor two texts share can repeat. The anchors of packs of texts go, four bytes
each, to the task of their leading bits, which tells every pack which of them others have too. Around those, the texts
send pieces of bytes to the shard of the anchor, and at an anchor that very many places have, windows one by one. A
shard's distinct pieces are one text, whose suffixes at window starts are sorted bucket by bucket; neighbours that
share WINDOW bytes are equal windows, and the smallest document of each such stretch holds it first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, lean, materialise, others, partitions_for, prepare, read
from .suffix_blocks import equal_runs
from .words import mix, slices, text_buffers

WINDOW, GRAM = 50, 24
#: Windows that can have one gram, and at most those of a piece.
SPAN = WINDOW - GRAM + 1
#: Bytes of text whose anchors are found at once, of a pack, and of a shard after which the next one begins.
CHUNK, PACK_BYTES, SHARD_BYTES = 1 << 18, 8 << 20, 4 << 20
#: Anchors that go to one route, about.
ROUTE_ANCHORS = 1 << 15
#: Places from which on the windows at an anchor are dealt one by one.
HOT_PLACES = 30_000
#: Parts pieces of UTF-8, in which it never occurs.
GAP = 0xFF

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BASE = 0x2545F4914F6CDD1D
_POWER = np.array([pow(_BASE, k, 1 << 64) for k in range(SPAN + WINDOW)], np.uint64)


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def window_keys(data: np.ndarray) -> np.ndarray:
    """The smallest hash of the grams of each window."""
    with np.errstate(over="ignore"):
        h = _BYTE[data]
        sums = {}
        for k in (1, 2, 4, 8):
            h = h[:-k] * _POWER[k] + h[k:]
            sums[2 * k] = h
        h = h[:-8] * _POWER[8] + sums[8][16:]
        h = (h ^ (h >> np.uint64(32))) * _GOLD
    for k in (1, 2, 4, 8, SPAN - 16):
        h = np.minimum(h[:-k], h[k:])
    return h


def runs(raw: np.ndarray, offs: np.ndarray):
    """Runs of up to SPAN windows with one anchor, in order and some at a time: document, first window (its byte in the
    document), windows, and a hash of the anchor."""
    for i, j in slices(offs, CHUNK):
        for lo in range(int(offs[i]), max(int(offs[j]) - WINDOW + 1, 0), CHUNK):
            hi = min(lo + CHUNK + WINDOW - 1, int(offs[j]))
            starts = np.maximum(offs[i:j], lo) - lo
            counts = np.maximum(np.minimum(offs[i + 1 : j + 1], hi) - lo - starts - WINDOW + 1, 0)
            if not counts.any():
                continue
            at = _within(counts) + np.repeat(starts, counts)
            key = window_keys(raw[lo:hi])[at]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)))
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(at)))
            if length.max() > SPAN:
                new |= _within(length) % SPAN == 0
                first = np.flatnonzero(new)
                length = np.diff(np.append(first, len(at)))
            doc = i + np.searchsorted(np.cumsum(counts), first, side="right")
            with np.errstate(over="ignore"):
                yield doc, at[first] + lo - offs[doc], length, mix(key[first] + _GOLD)


def _stretches(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that agree in these columns."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    bounds = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    yield from ((a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary entries of the values between bounds."""
    width = values.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _anchors(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by pack; gives for each pack and route the distinct anchors and, in 15 bits, their places, and in the
    16th whether several texts have them."""
    now, keys, owners, texts = None, [], [], 0

    def out() -> pa.RecordBatch:
        value, owner = np.concatenate(keys) >> np.uint64(32 - bits), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        last = np.append(first[1:], len(value))
        count = np.minimum(last - first, 32767) | (owner[first] != owner[last - 1]).astype(np.int64) << 15
        value = value[first]
        route = (value >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
        bounds = np.append(begin, len(value))
        return pa.RecordBatch.from_arrays(
            [pa.array(route[begin]), pa.array(np.full(len(begin), now)), _blobs(value.astype(np.uint32), bounds), _blobs(count.astype(np.uint16), bounds)],
            names=["route", "pack", "low", "count"],
        )

    for batch in batches:
        packs, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pack", "text_key"))
        raw, offs = text_buffers(batch.column("text"))
        for a, b in _stretches(packs):
            if keys and packs[a] != now:
                yield out()
                keys, owners, texts = [], [], 0
            now = packs[a]
            for doc, _, _, key in runs(raw, offs[a : b + 1]):
                keys.append(key)
                owners.append(np.searchsorted(np.flatnonzero(names[a + 1 : b] != names[a : b - 1]), doc) + texts)
            texts += b - a
    if keys:
        yield out()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by route; gives each pack those of its anchors that several texts have, and which are hot."""
    now, packs, lows, counts = None, [], [], []

    def out() -> pa.RecordBatch:
        sizes = np.array([len(x) for x in lows])
        low, count = np.concatenate(lows), np.concatenate(counts).astype(np.int64)
        names, back, held = np.unique(low, return_inverse=True, return_counts=True)
        places = np.bincount(back, count & 32767, len(names))
        several = (held > 1) | (np.bincount(back, count >> 15, len(names)) > 0)
        keep = several[back]
        bounds = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(sizes)))]
        some = np.flatnonzero(np.diff(bounds))
        ends = np.concatenate(([0], bounds[some + 1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), now)), pa.array(np.asarray(packs)[some]), _blobs(low[keep], ends), _blobs((places >= HOT_PLACES)[back][keep], ends)], names=["route", "pack", "low", "hot"]
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("route", "pack", "low", "count"))
        for route, pack, low, count in zip(*columns, strict=True):
            if packs and route != now:
                yield out()
                packs, lows, counts = [], [], []
            now = route
            packs.append(pack)
            lows.append(np.frombuffer(low, np.uint32))
            counts.append(np.frombuffer(count, np.uint16))
    if packs:
        yield out()


def _cut(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by pack, its common anchors before its texts; gives the pieces around those anchors and where each is
    to go. Every piece of every text is a row with its place; its bytes come only with the first one of some, next to
    the smallest document among these that has it."""
    now, held, hots, ready = None, [], [], None
    for batch in batches:
        packs, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pack", "kind"))
        for a, b in _stretches(packs, kinds):
            if packs[a] != now:
                now, held, hots, ready = packs[a], [], [], None
            rows = batch.slice(a, b - a)
            if kinds[a] == 0:
                for route, low, hot in zip(*(rows.column(c).to_pylist() for c in ("route", "low", "hot")), strict=True):
                    held.append(np.frombuffer(low, np.uint32).astype(np.uint64) | np.uint64(route << 32))
                    hots.append(np.frombuffer(hot, bool))
                continue
            if not held:
                continue
            if ready is None:
                value, crowded = np.concatenate(held), np.concatenate(hots)
                order = np.argsort(value)
                ready = value[order], crowded[order]
            yield from _pieces(rows, *ready, bits)


def _pieces(rows: pa.RecordBatch, common: np.ndarray, crowded: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    docs, names = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
    raw, offs = text_buffers(rows.column("text"))
    for doc, start, count, key in runs(raw, offs):
        value = key >> np.uint64(32 - bits)
        near = np.minimum(np.searchsorted(common, value), len(common) - 1)
        hit = common[near] == value
        if not hit.any():
            continue
        doc, start, count, route, hot = doc[hit], start[hit], count[hit], key[hit], crowded[near[hit]]
        if hot.any():
            times = np.where(hot, count, 1)
            doc, start, count, route, hot = (np.repeat(x, times) for x in (doc, start, count, route, hot))
            start, count = start + np.where(hot, _within(times), 0), np.where(hot, 1, count)
        length = count + WINDOW - 1
        step = _within(length)
        taken = raw[step + np.repeat(offs[doc] + start, length)]
        ends = np.cumsum(length)
        with np.errstate(over="ignore"):
            piece = mix(np.add.reduceat(_BYTE[taken] * _POWER[step], ends - length) + length.astype(np.uint64) * _GOLD)
            route = np.where(hot, mix(route + piece), route)
        order = np.lexsort((docs[doc], piece))
        lead = np.concatenate(([True], piece[order][1:] != piece[order][:-1]))
        bears = np.zeros(len(piece), bool)
        bears[order[lead]] = True
        bounds = np.concatenate(([0], np.cumsum(np.where(bears, length, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(route.view(np.int64)),
                pa.array(piece.view(np.int64)),
                pa.array(docs[doc]),
                pa.array(names[doc]),
                pa.array(start.astype(np.int32)),
                pa.array(count.astype(np.int32)),
                pa.BinaryArray.from_buffers(pa.binary(), len(piece), [pa.py_buffer(np.packbits(bears, bitorder="little")), pa.py_buffer(bounds), pa.py_buffer(taken[np.repeat(bears, length)])]),
            ],
            names=["route", "piece", "doc_id", "text_key", "start", "windows", "bytes"],
        )


def smallest_holders(segments: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of bytes and the smallest document of each: the smallest document that holds each window of theirs,
    one entry for every byte of the pieces laid end to end with a gap behind each; and where each piece begins."""
    length = np.array([len(s) for s in segments])
    begin = np.cumsum(length + 1) - length - 1
    text = np.full(int(length.sum()) + len(length), GAP, np.uint8)
    text[np.repeat(begin, length) + _within(length)] = np.frombuffer(b"".join(segments), np.uint8)
    found = np.repeat(docs, length + 1)
    count = np.maximum(length - WINDOW + 1, 0)
    owner = found.copy()
    for at, same in equal_runs(text, np.repeat(begin, count) + _within(count), WINDOW):
        first = np.flatnonzero(~same)
        found[at] = np.repeat(np.minimum.reduceat(owner[at], first), np.diff(np.append(first, len(at))))
    return found, begin


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by route; gives for each distinct piece the smallest document that holds all of its windows, or a list
    of those that hold each."""
    number: dict[bytes, int] = {}
    least: list[int] = []
    names: list[int] = []
    size, now = 0, None

    def out() -> pa.RecordBatch:
        found, begin = smallest_holders(list(number), np.asarray(least))
        count = np.array([len(s) for s in number]) - WINDOW + 1
        flat = found[np.repeat(begin, count) + _within(count)]
        starts = np.cumsum(count) - count
        one = np.minimum.reduceat(flat, starts)
        mixed = np.maximum.reduceat(flat, starts) != one
        bounds = np.concatenate(([0], np.cumsum(np.where(mixed, count, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat[np.repeat(mixed, count)]), mask=pa.array(~mixed))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(one), lists], names=["piece", "holder", "holders"])

    for batch in batches:
        for at, piece, doc, content in zip(*(batch.column(c).to_pylist() for c in ("route", "piece", "doc_id", "bytes")), strict=True):
            if at != now and size > SHARD_BYTES:
                yield out()
                number, least, names, size = {}, [], [], 0
            now = at
            k = number.setdefault(content, len(least))
            if k == len(least):
                least.append(doc)
                names.append(piece)
                size += len(content)
            elif doc < least[k]:
                least[k] = doc
    if least:
        yield out()


def repeated(docs: DataFrame) -> DataFrame:
    """Rows ``text_key, first_id, spans``: for each text the smallest doc_id that has it and, as pairs of a byte and a
    mask of the windows from it on, those windows of that document that a smaller document holds too."""
    spark = docs.sparkSession
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    firsts = materialise(base.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.max(F.octet_length("text")).cast("long").alias("n")), "repeats-firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    n = partitions_for(spark)
    # Within a task's texts, leading bits of their keys make packs; routes are as many as the anchors need.
    cut_bits = max(0, math.ceil(math.log2(max(1, total / (n * PACK_BYTES)))))
    bits = min(24, max(4, math.ceil(math.log2(max(1, 2 * total / SPAN / ROUTE_ANCHORS)))))
    part = F.shiftrightunsigned("text_key", 64 - cut_bits) if cut_bits else F.lit(0).cast("long")
    pack = F.shiftleft(F.spark_partition_id().cast("long"), 32).bitwiseOR(part)
    wanted = firsts.where(F.col("n") >= WINDOW).select("text_key", "first_id")
    once = base.join(wanted, "text_key").where("doc_id = first_id").select(pack.alias("pack"), "text_key", "doc_id", "text")
    packs = materialise(once.sortWithinPartitions("pack", "text_key"), "repeats-packs")
    anchors = packs.select("pack", "text_key", "text").mapInArrow(lean(_anchors, bits), "route long, pack long, low binary, count binary")
    common = materialise(anchors.repartition(n, "route").sortWithinPartitions("route").mapInArrow(lean(_common), "route long, pack long, low binary, hot binary"), "repeats-common")
    blank = {c: F.lit(None).cast(t) for c, t in (("route", "long"), ("low", "binary"), ("hot", "binary"), ("doc_id", "long"), ("text_key", "long"), ("text", "string"))}
    both = common.withColumns({c: blank[c] for c in ("doc_id", "text_key", "text")}).withColumn("kind", F.lit(0))
    both = both.unionByName(packs.withColumns({c: blank[c] for c in ("route", "low", "hot")}).withColumn("kind", F.lit(1)))
    schema = "route long, piece long, doc_id long, text_key long, start int, windows int, bytes binary"
    cut = materialise(both.repartition(n, "pack").sortWithinPartitions("pack", "kind").mapInArrow(lean(_cut, bits), schema), "repeats-pieces")
    drop(packs, common)
    shards = cut.where("bytes is not null").select("route", "piece", "doc_id", "bytes").repartition(n, "route").sortWithinPartitions("route")
    held = shards.mapInArrow(lean(_shard), "piece long, holder long, holders array<long>")
    places = cut.select("piece", "text_key", "doc_id", "start", "windows").join(held, "piece")
    bit = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(1).cast("long").alias("bit"))
    single = F.aggregate("holders", bit, lambda a, x: F.struct((a["mask"] + F.when(x < F.col("doc_id"), a["bit"]).otherwise(0)).alias("mask"), (a["bit"] * 2).alias("bit")), lambda a: a["mask"])
    mask = F.when(F.col("holders").isNotNull(), single).when(F.col("holder") < F.col("doc_id"), F.expr("shiftleft(1L, windows)") - 1).otherwise(0)
    masks = materialise(places.select("text_key", "start", mask.alias("mask")).where("mask <> 0"), "repeats-masks")
    drop(cut)
    lists = masks.groupBy("text_key").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))
    found = materialise(firsts.select("text_key", "first_id").join(lists, "text_key", "left"), "repeats-marks")
    drop(firsts, masks)
    return found


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = text_buffers(batch.column("text"))
        copy = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
        spans = batch.column("spans")
        bounds = np.concatenate(([0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())))
        flat = spans.flatten()
        start, mask = (flat.field(k).to_numpy() for k in range(2))
        for i, j in slices(offs):
            base, n = int(offs[i]), np.diff(offs[i : j + 1])
            change = np.zeros(int(offs[j]) - base + 1, np.int32)
            whole = i + np.flatnonzero(copy[i:j] & (n >= WINDOW))
            np.add.at(change, offs[whole] - base, 1)
            np.add.at(change, offs[whole + 1] - base, -1)
            own = slice(bounds[i], bounds[j])
            first = start[own] + np.repeat(offs[i:j] - base, np.diff(bounds[i : j + 1]))
            for step in range(SPAN):
                at = first[(mask[own] >> step) & 1 == 1] + step
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
            covered = np.cumsum(change)[:-1] > 0
            edge = np.zeros(len(covered) + 1, bool)
            edge[offs[i : j + 1] - base] = True
            begins = covered & (edge[:-1] | ~np.concatenate(([False], covered[:-1])))[: len(covered)]
            rel = offs[i : j + 1] - base
            sums = [np.concatenate(([0], np.cumsum(x)))[rel] for x in (covered, begins, ~covered)]
            kept = _blobs(raw[base : int(offs[j])][~covered], sums[2])
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(n), pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])), kept], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_byte_repeats(docs: DataFrame) -> DataFrame:
    """The columns of docs but ``text``, in a struct ``row``; ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept``, the bytes that no repeated window covers.

    A window, WINDOW bytes of one text's UTF-8, is repeated when it also starts in a document with a smaller doc_id;
    all windows are judged on the texts as they came. What is kept may begin or end within a character. Null texts are
    empty. Rows without doc_id keep everything and count for no other. Repeated rows are one document and keep the
    same bytes; so do the texts of rows that share a doc_id. Windows are compared byte by byte; texts, pieces and
    anchors are told apart by 64-bit hashes. A text of any length is one record of this and of no other step: its
    pieces go to shards of bounded size. Columns of any name pass in ``row``. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in others(docs.columns, "text")]
    whole = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A table of its own: a join with it can split a text that very many documents are copies of.
    marks = repeated(whole.select(F.col("_id").alias("doc_id"), "text"))
    both = whole.withColumn("text_key", F.xxhash64("text")).join(marks, "text_key", "left")
    spans = F.when(F.col("_id") == F.col("first_id"), F.col("spans"))
    ready = both.select("row", "text", F.coalesce(F.col("_id") > F.col("first_id"), F.lit(False)).alias("copy"), spans.alias("spans"))
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return ready.mapInArrow(lean(_remove), T.StructType([ready.schema["row"], *counts, T.StructField("kept", T.BinaryType())]))


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_byte_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT DISTINCT doc_id, i, hash(b[i:i + 49]) AS h
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM t WHERE octet_length(b) >= 50)),
m AS (SELECT h, min(doc_id) AS d FROM w GROUP BY h),
s AS (SELECT DISTINCT doc_id, i FROM w JOIN m USING (h) WHERE d < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM g GROUP BY doc_id, r),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM spans GROUP BY doc_id),
rest AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM spans
  UNION ALL SELECT doc_id, max(z) + 1, NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[x:coalesce(y, octet_length(b))]), '' ORDER BY x) AS k
  FROM rest JOIN (SELECT DISTINCT doc_id, b FROM t) USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN k IS NULL THEN b ELSE unhex(k) END) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
