"""Token ids in binary shard files: one concatenated id array and Elias-Fano coded document boundaries."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean, materialise, new_path, partitions_for, read, vocabulary
from .words import compact_words, slices, text_buffers

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Ids in a shard file before the next one begins (a single longer document still stays in one file).
SHARD_IDS = 4 << 20
#: Distinct words after which a worker's memory begins anew, keeping the last one beside it for words that come again.
MEMO_WORDS = 500_000

MAGIC = b"EFIDS\x00\x00\x01"
#: part, shard, documents, of these without id, ids, bytes an id.
HEAD = struct.Struct("<IIQQQI")
EF_HEAD = struct.Struct("<QqQII")
#: Ones between two select samples.
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(range / n) bits each.

    The low bits of each value lie packed side by side, the high bits as gaps in a bit vector. ``select`` finds the
    i-th one in that vector from a 32-bit sample every SAMPLE ones, so values are read without decoding the others and
    without a table of 64-bit offsets.
    """

    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.least, self.low_bits, self.low, self.high = n, least, low_bits, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        rel = values.astype(np.uint64) - values[:1].astype(np.uint64)
        low_bits = max(0, (int(rel[-1]) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (rel[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (rel >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return cls(n, int(values[0]), low_bits, low, np.packbits(high, bitorder="little"))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _index(self) -> None:
        """For every SAMPLE-th one the byte of the high bits that holds it and the ones before that byte."""
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.uint32)
        self._samples = np.searchsorted(ones, np.arange(0, self.n, SAMPLE) + 1).astype(np.uint32)
        self._before = (ones[self._samples] - np.bitwise_count(self.high[self._samples])).astype(np.uint32)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.select_run(i, i + 1)[0])

    def select_run(self, first: int, last: int) -> np.ndarray:
        """The values from the first to before the last: only the stretch of high bits between their samples is read."""
        if not 0 <= first < last <= self.n:
            raise IndexError((first, last))
        if self._samples is None:
            self._index()
        s, e = first // SAMPLE, (last - 1) // SAMPLE + 1
        at, seen = int(self._samples[s]), int(self._before[s])
        stop = int(self._samples[e]) + 1 if e < len(self._samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:stop], bitorder="little"))
        places = at * 8 + ones[first - seen : last - seen]
        rel = ((places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(first, last)
        return (rel + np.array([self.least], np.int64).astype(np.uint64)).astype(np.int64)

    def to_bytes(self) -> bytes:
        return EF_HEAD.pack(self.n, self.least, len(self.low), self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, least, n_low, low_bits, n_high = EF_HEAD.unpack_from(data, at)
        at += EF_HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, least, low_bits, low, high), at + n_low + n_high


def pack_shard(part: int, k: int, doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One shard file. Documents come in ascending id order, those without an id first."""
    named = [d for d in doc_ids if d is not None]
    bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    head = HEAD.pack(part, k, len(doc_ids), len(doc_ids) - len(named), int(bounds[-1]), width)
    return b"".join((MAGIC, head, EliasFano.encode(np.asarray(named, np.int64)).to_bytes(), EliasFano.encode(bounds).to_bytes(), ids))


class Shard:
    """A shard file in memory: documents are found by their boundaries' select."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("this is no shard file of token ids")
        self.part, self.k, self.n_docs, self.n_null, self.n_ids, self.width = HEAD.unpack_from(data, len(MAGIC))
        self.docs, at = EliasFano.from_buffer(data, len(MAGIC) + HEAD.size)
        self.bounds, at = EliasFano.from_buffer(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """Ids of the documents from the first to before the last."""
        named = (max(first, self.n_null) - self.n_null, last - self.n_null)
        return [None] * (max(0, min(last, self.n_null) - first)) + (self.docs.select_run(*named).tolist() if named[1] > named[0] else [])

    def __getitem__(self, i: int) -> np.ndarray:
        start, end = self.bounds.select_run(i, i + 2)
        return self.ids[start:end]

    def runs(self, most: int = 4096) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents in runs: the first, the one after the last, and all their boundaries, found by select."""
        for i in range(0, self.n_docs, most):
            j = min(i + most, self.n_docs)
            yield i, j, self.bounds.select_run(i, j + 1)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(path))


class WordEncoder:
    """Encodes texts with the tokenizer, each distinct word once while it is remembered.

    The tokenizer drops white space and none of its steps looks across it, so a text's ids are its words' ids one
    after the other; the words here are cut at ASCII white space only. Arrow finds a batch's distinct words. New words
    of plain letters and punctuation go piece by piece to the tokenizer's model where its other steps do no more than
    spell such pieces in its byte alphabet; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A tokenizer that lower-cases gives a word's ids for its lower-case form too, so that one is remembered.
        self.lowers = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("AZ") == "az"
        self.plain = re.compile(r"[a-zß-öø-ÿ!-&(-/:-@\[-`{-~]+").fullmatch
        self.parts = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+").findall
        self.spell = {c: "".join(x[0] for x in self.tok.pre_tokenizer.pre_tokenize_str(chr(c))) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
        probes = ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, self.spell)), r"!\"#$%&()*+,-./:;=?@[\]^_`{}~>|<", "a.b", "é,ü!!", "x***", "(ñ)"]
        self.straight = all(self._pieces(w) == self.tok.encode(w, add_special_tokens=False).ids for w in [*probes, *"".join(probes)])

    def _pieces(self, word: str) -> list[int]:
        tokenize, spell = self.tok.model.tokenize, self.spell
        return [t.id for p in self.parts(word) for t in tokenize(p if p.isascii() else p.translate(spell))]

    def _learn(self, words: list[str]) -> None:
        rest = []
        kind = "H" if self.width == 2 else "I"
        for w in words:
            if self.straight and self.plain(w) and "<|" not in w:
                self.memo[w] = array(kind, self._pieces(w)).tobytes()
            else:
                rest.append(w)
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            found = self.tok.encode_batch_fast([[w] for w in part], is_pretokenized=True, add_special_tokens=False)
            self.memo.update((w, array(kind, x.ids).tobytes()) for w, x in zip(part, found, strict=True))

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents between these offsets, one after the other, and each document's number of ids."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        words, begins = compact_words(raw, offs, self.lowers)
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if not distinct:
            return np.zeros(0, self.kind), np.zeros(len(offs) - 1, np.int64)
        memo, older = self.memo, self.older
        found = list(map(memo.get, distinct))
        new = [w for w, x in zip(distinct, found, strict=True) if x is None]
        if new:
            memo.update((w, older[w]) for w in new if w in older)
            self._learn([w for w in new if w not in memo])
            found = list(map(memo.__getitem__, distinct))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        flat, first = np.frombuffer(b"".join(found), self.kind), np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(first[which] - (ends - n), n)]
        return ids, np.diff(np.concatenate(([0], ends))[begins])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """A worker's encoder, which keeps its memory from one task to the next."""
    return WordEncoder(path)


def _write(batches: Iterator[pa.RecordBatch], path: str, out: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(out)
    enc = word_encoder(path)
    end = np.asarray([end_id], f"<u{enc.width}").tobytes()
    context = TaskContext.get()
    part, k = context.partitionId(), 0
    docs: list = []
    lengths: list[int] = []
    parts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal k, held
        name = f"{folder}/{part:07d}-{k:05d}.efids"
        staged = f"{folder}/.{part:07d}-{k:05d}-{context.taskAttemptId()}"
        with store.open_output_stream(staged) as f:
            f.write(pack_shard(part, k, docs, lengths, b"".join(parts), enc.width))
        store.move(staged, name)  # a task that runs again writes the same bytes
        row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "n_ids": pa.array([sum(lengths)], pa.int64())})
        docs.clear(), lengths.clear(), parts.clear()
        k, held = k + 1, 0
        return row

    for batch in batches:
        raw, offs = text_buffers(batch.column("text"))
        names = batch.column("doc_id")
        for i, j in slices(offs, 16 << 20):
            ids, counts = enc.encode(raw, offs[i : j + 1])
            ends = np.cumsum(counts)
            for doc, a, b in zip(names.slice(i, j - i).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                docs.append(doc)
                parts += ids[a:b].tobytes(), end
                lengths.append(b - a + 1)
                held += b - a + 1
                if held >= shard_ids:
                    yield flush()
    if docs:
        yield flush()


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes the texts by the tokenizer at ``path`` (or the public one of that name) and writes shard files to the
    folder ``out`` (a URI that pyarrow can write); returns the manifest ``part, k, n_ids``, whose order by part and k is the order of the ids.

    Documents go by range of doc_id (texts' hashes break ties, so that many rows without id still spread), shards
    follow one another in ascending order. Null or empty text: only the end id. Null ids come first. Repeated rows
    are written each. An empty table writes no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(out)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions_for(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    return materialise(ordered.mapInArrow(lean(_write, path, out, end_id, shard_ids), "part int, k int, n_ids long"), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            shard = Shard(content.as_buffer().to_pybytes())
            for i, j, bounds in shard.runs():
                crcs = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard.part, np.int32)), pa.array(np.full(n, shard.k, np.int32)), pa.array(shard.doc_ids(i, j), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                    names=["part", "k", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )


def read_token_files(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (in all ids of all shards), n_tokens, ids_crc32."""

    def before(window):
        return F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")

    # A row here is a writing task, then a shard file, never a document.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("_first"))
    bases = manifest.withColumn("_in", before(Window.partitionBy("part").orderBy("k"))).join(parts, "part").select("part", "k", (F.col("_first") + F.col("_in")).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.efids").load(out).select("content")
    rows = files.mapInArrow(lean(_read), "part int, k int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "k"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    manifest = write_token_files(read(spark, sf_dir, "documents"), TOKENIZER, out)
    return read_token_files(spark, out, manifest)
