"""Removing passages that repeat across documents, found with FM-indexes of word shards.

A window is WINDOW consecutive words. Of the runs of GRAM words in a window the one with the smallest hash is its
anchor, so equal windows have equal anchors, and only runs that are the anchor of windows of two different texts can
lie in a repeated window. For those anchors, every text sends the words of the windows around them to the shard of the
anchor's hash; windows at an anchor of very many places go to shards one by one. A shard holds its distinct
pieces in an FM-index; streamed against it, they come back with matching statistics. Where these reach a whole window
at two places or more, the windows of one interval are equal, and the smallest document among them holds it first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FmIndex
from .shared import drop, lean, materialise, partitions_for, read
from .words import Words, grams, mix, pieces

WINDOW, GRAM = 13, 5
#: Words after which a task's shard is indexed and the next one begins, at a new route.
SHARD_WORDS = 600_000
#: Texts a task remembers so as to send their anchors once.
SEEN = 300_000
#: Places, in all texts together, from which on the windows at an anchor are dealt one by one: it bounds what comes to
#: a shard after SHARD_WORDS.
HOT_PLACES = 2000


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document's windows, in order, those runs with one anchor: the anchor's hash, the document's place among
    these, the run's first window (word number in the document) and its number of windows."""
    found, begins = grams(words, GRAM)
    span = WINDOW - GRAM + 1
    counts = np.maximum(np.diff(words.offsets) - WINDOW + 1, 0)
    none = np.zeros(0, np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), none, none, none
    at = np.lib.stride_tricks.sliding_window_view(found, span).argmin(axis=1) + np.arange(len(found) - span + 1)
    ends = np.cumsum(counts)
    window = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    at = at[window + np.repeat(begins[:-1], counts)]  # grams of two documents have different places
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return found[at[new]], doc[new], window[new], np.diff(np.append(new, len(at)))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each text that the task meets for the first time, and at how many places it has each."""
    seen: set[int] = set()
    for batch in batches:
        keys = batch.column("text_key").to_pylist()
        keep = []
        for r, key in enumerate(keys):
            if key not in seen:
                keep.append(r)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
        rows = batch.take(pa.array(keep, pa.int64()))
        own = rows.column("text_key").to_numpy(zero_copy_only=False)
        for i, j, words in pieces(rows):
            h, doc, _, _ = anchors(words)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
            places = np.diff(np.append(np.flatnonzero(new), len(h)))
            h, doc = h[new], doc[new]
            yield pa.RecordBatch.from_arrays([pa.array(own[i:j][doc]), pa.array(h.view(np.int64)), pa.array(places.astype(np.int32))], names=["text_key", "anchor", "places"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the wanted anchors of each text, the pieces of the windows around them, and where each is to go: by its
    anchor, or for a hot one by anchor and window. Every piece of every document gives a row with its place; its word hashes come only with the first one of a batch, next to the batch's smallest
    document that has it."""
    for batch in batches:
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys = batch.column("text_key").to_numpy(zero_copy_only=False)
        wanted = batch.column("anchors")
        flat, offs = wanted.values.to_numpy().view(np.uint64), wanted.offsets.to_numpy()
        crowded = batch.column("hot").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        for i, j, words in pieces(batch):
            h, doc, first, count = anchors(words)
            ask = np.repeat(np.arange(j - i), np.diff(offs[i : j + 1]))
            pairs = np.stack((ask.astype(np.uint64), flat[offs[i] : offs[j]]), axis=1)
            have = np.stack((doc.astype(np.uint64), h), axis=1)
            hit = np.isin(have.view("V16").ravel(), np.ascontiguousarray(pairs).view("V16").ravel()) if len(h) else np.zeros(0, bool)
            if not hit.any():
                continue
            h, doc, first, count = h[hit], doc[hit], first[hit], count[hit]
            hot = np.isin(h, crowded)
            if hot.any():
                times = np.where(hot, count, 1)
                nth = np.where(np.repeat(hot, times), _within(times), 0)
                h, doc, first, hot = (np.repeat(x, times) for x in (h, doc, first, hot))
                first, count = first + nth, np.where(hot, 1, np.repeat(count, times))
            length = count + WINDOW - 1
            ends = np.cumsum(length)
            taken = words.hashes[_within(length) + np.repeat(words.offsets[:-1][doc] + first, length)]
            with np.errstate(over="ignore"):
                spread = mix(taken + _within(length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                piece = mix(np.add.reduceat(spread, ends - length) + length.astype(np.uint64))
                route = np.where(hot, mix(h + piece), h)
            # Of equal pieces the one of the smallest document carries the words.
            order = np.lexsort((docs[i:j][doc], piece))
            lead = np.concatenate(([True], piece[order][1:] != piece[order][:-1]))
            bears = np.zeros(len(h), bool)
            bears[order[lead]] = True
            size = np.where(bears, length * 8, 0)
            data = taken[np.repeat(bears, length)]
            bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            blank = pa.py_buffer(np.packbits(bears, bitorder="little"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(route.view(np.int64)),
                    pa.array(piece.view(np.int64)),
                    pa.array(docs[i:j][doc]),
                    pa.array(keys[i:j][doc]),
                    pa.array(first.astype(np.int32)),
                    pa.BinaryArray.from_buffers(pa.binary(), len(h), [blank, pa.py_buffer(bounds), pa.py_buffer(data)]),
                ],
                names=["route", "piece", "doc_id", "text_key", "start", "words"],
            )


def smallest_holders(segments: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of words and the smallest document of each: the smallest document that holds each window of theirs,
    one entry for every place of the pieces laid end to end; where each piece begins there, and its number of words."""
    words = [np.frombuffer(s, np.uint64) for s in segments]
    length = np.array([len(w) for w in words])
    begin = np.cumsum(length + 1) - length - 1
    flat = np.concatenate(words)
    # Frequent words get small numbers.
    names, back, often = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.empty(len(names), np.int64)
    number[np.argsort(-often, kind="stable")] = np.arange(1, len(names) + 1)
    total = int(length.sum()) + len(length)
    text = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[begin + length] = False
    text[inside] = number[back]
    owner = np.repeat(docs, length + 1)

    found = owner.copy()
    matched, interval, _ = FmIndex(text).matching(text, WINDOW, 2)
    ends = np.flatnonzero(matched == WINDOW)
    if len(ends):
        # Windows of one interval are equal, and all places of it are in the stream.
        order = np.argsort(interval[ends], kind="stable")
        same, starts = interval[ends[order]], ends[order] - WINDOW + 1
        first = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
        least = np.minimum.reduceat(owner[starts], first)
        found[starts] = np.repeat(least, np.diff(np.append(first, len(starts))))
    return found, begin, length


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _shard(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    """Rows come by route; gives for each piece of which some window is also in another piece, or in several
    documents, the smallest document that holds each of its windows."""
    number: dict[bytes, int] = {}
    least: list[int] = []
    names: list[int] = []
    size, now = 0, None

    def out() -> pa.RecordBatch:
        found, begin, length = smallest_holders(list(number), np.asarray(least))
        count = length - WINDOW + 1
        flat = found[np.repeat(begin, count) + _within(count)]
        ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["piece", "holders"])

    for batch in batches:
        route = batch.column("route").to_numpy()
        columns = (batch.column(c).to_pylist() for c in ("piece", "doc_id", "words"))
        for at, piece, doc, words in zip(route.tolist(), *columns, strict=True):
            if at != now and size > shard_words:
                yield out()
                number, least, names, size = {}, [], [], 0
            now = at
            k = number.setdefault(words, len(least))
            if k == len(least):
                least.append(doc)
                names.append(piece)
                size += len(words) // 8
            elif doc < least[k]:
                least[k] = doc
    if least:
        yield out()


def repeated(docs: DataFrame) -> DataFrame:
    """Rows ``text_key, first_id, starts, masks``: for each text the smallest doc_id that has it and, of the windows of
    that document, those that a smaller document holds too. Rows without doc_id take no part."""
    spark = docs.sparkSession
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    firsts = base.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    sent = materialise(base.select("text", "text_key").mapInArrow(lean(_anchors), "text_key long, anchor long, places int"), "substring-anchors")
    counts = sent.groupBy("anchor").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.sum("places").alias("places")).where("low < high")
    # A table of its own: a join with it can split an anchor that very many texts have.
    common = materialise(counts.select("anchor", (F.col("places") > HOT_PLACES).alias("hot")), "substring-common")
    shared = sent.select("text_key", "anchor").join(common, "anchor")
    lists = shared.groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    wanted = lists.join(firsts, "text_key").select(F.col("text_key").alias("_key"), F.col("first_id").alias("_id"), "anchors", "hot")
    texts = base.join(wanted, (F.col("text_key") == F.col("_key")) & (F.col("doc_id") == F.col("_id")))
    cut = materialise(
        texts.select("doc_id", "text_key", "text", "anchors", "hot").mapInArrow(lean(_cut), "route long, piece long, doc_id long, text_key long, start int, words binary"), "substring-pieces"
    )
    drop(sent, common)
    # Equal pieces go to the shards a few times at most; their many places wait for the answer outside.
    shards = cut.where("words is not null").select("route", "piece", "doc_id", "words").repartition(partitions_for(spark), "route").sortWithinPartitions("route")
    holders = shards.mapInArrow(lean(_shard, SHARD_WORDS), "piece long, holders array<long>")
    places = cut.select("piece", "text_key", "doc_id", "start").join(holders, "piece")
    mask = F.aggregate("holders", F.struct(F.lit(0).alias("mask"), F.lit(1).alias("bit")), lambda a, x: F.struct(
        (a["mask"] + F.when(x < F.col("doc_id"), a["bit"]).otherwise(0)).alias("mask"), (a["bit"] * 2).alias("bit")), lambda a: a["mask"])
    masks = materialise(places.select("text_key", "start", mask.alias("mask")).where("mask <> 0"), "substring-masks")
    drop(cut)
    lists = masks.distinct().groupBy("text_key").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    return firsts.join(lists, "text_key", "left").select("text_key", "first_id", F.col("spans.start").alias("starts"), F.col("spans.mask").alias("masks"))


def _apply(words: Words, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space, end to end, with offsets; and kept words a document."""
    kept = ~covered
    counts = np.diff(np.concatenate(([0], np.cumsum(kept)))[words.offsets])
    starts, length = words.starts[kept], (words.ends - words.starts)[kept]
    place = np.repeat(starts, length + 1) + _within(length + 1)
    out = words.data[np.minimum(place, max(len(words.data) - 1, 0))]
    ends = np.cumsum(length + 1)
    out[ends - 1] = 0x20
    bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
    return out, bounds, counts


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        copy = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
        starts, masks = batch.column("starts").to_pylist(), batch.column("masks").to_pylist()
        for i, j, words in pieces(batch):
            n = np.diff(words.offsets)
            change = np.zeros(len(words.starts) + 1, np.int64)
            for d in range(i, j):
                base = words.offsets[d - i]
                if copy[d]:
                    if n[d - i] >= WINDOW:
                        change[base] += 1
                        change[base + n[d - i]] -= 1
                elif starts[d]:
                    mask, first = np.asarray(masks[d]), np.asarray(starts[d])
                    for k in range(WINDOW - GRAM + 1):
                        at = base + first[(mask >> k) & 1 == 1] + k
                        np.add.at(change, at, 1)
                        np.add.at(change, at + WINDOW, -1)
            covered = np.cumsum(change)[:-1] > 0
            out, bounds, counts = _apply(words, covered)
            texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            last = pa.array([t.decode() for t in texts], pa.string()) if with_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(n), pa.array(n - counts), last], names=["row", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """The columns of docs but ``text``, in a struct ``row``; ``n_words``, ``n_removed`` and ``kept``: the words that no
    repeated window covers, joined by one space (or, without text, its sha256 in hex).

    A window is repeated when its word sequence also starts in a document with a smaller doc_id; all windows are
    judged on the texts as they came. Null texts are empty. Rows without doc_id keep all words and count for no other.
    Repeated rows are one document and keep the same words. Words are told apart by 64-bit hashes. A text of any length
    is read whole, some words at a time, and its pieces go to shards of bounded size. An empty table gives no rows.
    """
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    # A table of its own: a join with it can split a text that very many documents are copies of.
    marks = materialise(repeated(whole.select("doc_id", "text")), "substring-marks")
    others = [c for c in docs.columns if c != "text"]
    rows = whole.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("text_key"))
    both = rows.join(marks, "text_key", "left")
    first = F.col("_id") == F.col("first_id")
    ready = both.select("row", "text", F.coalesce(F.col("_id") > F.col("first_id"), F.lit(False)).alias("copy"), F.when(first, F.col("starts")).alias("starts"), F.when(first, F.col("masks")).alias("masks"))
    schema = T.StructType([ready.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return ready.mapInArrow(lean(_remove, with_text), schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT DISTINCT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
m AS (SELECT h, min(doc_id) AS d FROM v GROUP BY h),
f AS (SELECT DISTINCT v.doc_id, unnest(range(v.i, v.i + 13)) AS i FROM v JOIN m USING (h) WHERE m.d < v.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM f GROUP BY doc_id),
k AS (SELECT t.doc_id, len(w) AS n, [w[i] FOR i IN range(1, len(w) + 1) IF NOT coalesce(list_contains(gone, i), false)] AS kept
  FROM t LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
