"""Language identification with bit-sliced Bloom filters over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_fold, lean, materialise, others, read
from .words import mix, slices, text_buffers

#: Hashes an n-gram sets, slots for each distinct n-gram, and the fewest and most slots of a filter. More n-grams than
#: the most slots are meant for still all go in; only the rate of false positives, which is corrected, rises.
HASHES, ROOM, LEAST_SLOTS, MOST_SLOTS = 2, 4, 1 << 16, 1 << 22
#: Bytes of an n-gram, up to 8, and documents of each language that the filters are learned from.
GRAM, TRAIN_DOCS = 6, 600
UNKNOWN = "und"
#: Bytes of text that are looked up at once.
SLICE = 1 << 19

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)


def normalise(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single spaces for all else, each document between spaces; its bytes and offsets."""
    base = int(offs[0])
    rel = offs - base
    data = raw[base : int(offs[-1])]
    n_docs = len(offs) - 1
    low = _LETTER[data]
    if len(data) > 1:  # capital letters of Latin-1 in UTF-8
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][upper] += 0x20
    out = np.full(len(data) + 2 * n_docs, 0x20, np.uint8)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n_docs) + 1, np.diff(rel))
    out[place] = low
    ends = rel[1:] + 2 * np.arange(1, n_docs + 1)
    first = np.zeros(len(out), bool)
    first[np.concatenate(([0], ends[:-1]))[: n_docs]] = True
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20) | first[1:]
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[np.concatenate(([0], ends))]


def codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of GRAM bytes of each document as numbers, and where each document's begin. A document with fewer
    bytes has one, padded with spaces."""
    n = len(data)
    padded = np.concatenate((data, np.full(GRAM - 1, 0x20, np.uint8)))
    all_codes = padded[:n].astype(np.uint64)
    for k in range(1, GRAM):
        all_codes |= padded[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    length = np.diff(offs)
    counts = np.maximum(length - GRAM + 1, np.minimum(length, 1))
    begins = np.concatenate(([0], np.cumsum(counts)))
    take = np.arange(begins[-1]) - np.repeat(begins[:-1], counts) + np.repeat(offs[:-1], counts)
    found = all_codes[take]
    for i in np.flatnonzero((length > 0) & (length < GRAM)):
        piece = bytes(data[offs[i] : offs[i + 1]]).ljust(GRAM)
        found[begins[i]] = int.from_bytes(piece, "little")
    return found, begins


def slots(found: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The slots of n-grams in a filter of that size, a power of two; one array a hash."""
    h = mix(found + np.uint64(1))
    for j in range(HASHES):
        yield ((h >> np.uint64(32 * j)) & np.uint64(size - 1)).astype(np.int64)


def filter_size(distinct: int) -> int:
    """Slots for so many distinct n-grams."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (ROOM * distinct - 1).bit_length())) if distinct else LEAST_SLOTS


@dataclass
class Model:
    """Languages in code point order, the place of the most frequent one, and for each slot the bit sets of the
    languages (64 a word) with each language's rate of false positives."""

    langs: list[str]
    common: int
    table: np.ndarray
    false_rate: np.ndarray

    def score(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each document's language and its share of the document's n-grams."""
        found, begins = codes(*normalise(raw, offs))
        n = np.diff(begins).astype(float)
        at = list(slots(found, self.table.shape[1]))
        share = np.zeros((len(self.langs), len(n)))
        edges = begins[:-1][n > 0]
        for w in range(len(self.table)):
            held = self.table[w][at[0]]
            for more in at[1:]:
                held &= self.table[w][more]
            for i in range(64 * w, min(64 * (w + 1), len(self.langs))):
                if len(edges):
                    share[i, n > 0] = np.add.reduceat((held >> np.uint64(i - 64 * w)) & np.uint64(1), edges)
        with np.errstate(invalid="ignore", divide="ignore"):
            false = self.false_rate[:, None]
            share = np.where(n > 0, np.clip((share / n - false) / np.maximum(1 - false, 1e-9), 0, 1), 0)
        best = share.argmax(axis=0)
        best = np.where(share[self.common] >= share.max(axis=0), self.common, best)
        return best, share[best, np.arange(len(n))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, n-gram) over a task's texts."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (found, counts) in held.items():
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(counts[i : i + 50_000])], names=["lang", "code", "n"])

    for batch in batches:
        raw, offs = text_buffers(batch.column("text"))
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for i, j in slices(offs, SLICE):
            found, begins = codes(*normalise(raw, offs[i : j + 1]))
            whose = np.repeat(np.arange(i, j), np.diff(begins))
            for lang in set(langs[i:j]):
                part, n = np.unique(found[(langs == lang)[whose]], return_counts=True)
                if lang in held:
                    old, m = held[lang]
                    part, back = np.unique(np.concatenate((old, part)), return_inverse=True)
                    n = np.bincount(back, np.concatenate((m, n))).astype(np.int64)
                held[lang] = part, n
        if sum(len(x) for x, _ in held.values()) > 1 << 20:
            yield from out()
            held.clear()
    yield from out()


def learn(texts: DataFrame) -> Model:
    """The filters from rows (text, lang), all of them; rows where either is null are left out.

    A language's filter holds every n-gram of its texts, so a look-up returns all languages that have one. The driver
    gets the filter's slots only, of which there are MOST_SLOTS at most for every 64 languages.
    """
    rows = texts.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = materialise(rows.mapInArrow(lean(_count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "lang-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: x.encode())
    width = max(1, -(-len(langs) // 64))
    if not langs:
        return Model([], 0, np.zeros((1, LEAST_SLOTS), np.uint64), np.zeros(0))
    size = filter_size(counts.agg(F.count_distinct("code").alias("n")).first()["n"])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column("place").to_numpy(zero_copy_only=False)
            for at in slots(batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64), size):
                bit = (np.uint64(1) << (where % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((where // 64).astype(np.int32)), pa.array(at), pa.array(bit)], names=["word", "slot", "bits"])

    bits = counts.select("code", place[F.col("lang")].alias("place")).mapInArrow(to_slots, "word int, slot long, bits long")
    filled = bits.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros((width, size), np.uint64)
    table[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    fill = np.array([((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Model(langs, max(range(len(langs)), key=lambda i: (totals[langs[i]], -i)), table, fill**HASHES)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (default: all) with ``lang_pred`` and ``score``, the share of the text's n-grams that the language's filter
    holds, corrected for false positives.

    A null text or one without any letter, and any text where nothing was learned: ``und`` and 0. Ties go to the most
    frequent language of the learned texts, then to the first by code point. Columns of docs that are called like
    the results, in any case, are replaced; repeated rows are scored each; an empty table gives no rows.
    """
    kept = others(docs.columns if keep is None else keep, "lang_pred", "score")
    inside = "text" in kept  # then the text travels in the row alone
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MOST_SLOTS words at most for every 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            raw, offs = text_buffers(batch.column("row").field("text") if inside else batch.column("text"))
            letters = batch.column("letters")
            for i, j in slices(offs, SLICE):
                if model.langs:
                    best, score = model.score(raw, offs[i : j + 1])
                    has = letters.slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                    names = [model.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                    score = np.where(has, score, 0.0)
                else:
                    names, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *([] if inside else ["text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(run), schema).select("row.*", "lang_pred", "score")


def learn_from_documents(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Filters from a bounded sample of the documents whose crc32 fold is not 1: of each language the ``most`` rows that
    come first by the hash of their id, whole texts.

    A filter that holds every n-gram of ever more documents comes to hold, by quotations, junk and wrong labels, those
    of all languages; one of a fixed number of documents stays as sharp on a corpus of any size.
    """
    known = docs.where(crc_fold("doc_id", 3) != 1).where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"))
    first = Window.partitionBy("lang").orderBy("_h", "_t")
    # Hashes alone are ranked; the texts of the chosen ones are fetched after.
    chosen = known.select("lang", "_h", "_t").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("lang", "_h", "_t").distinct()
    return learn(known.join(F.broadcast(chosen), ["lang", "_h", "_t"], "left_semi"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn_from_documents(docs)
    found = docs.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "text")
    # Only ids come back from Python.
    return predict(found, model, keep=["doc_id", "held_out"])
