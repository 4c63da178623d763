"""Scoring whole documents with a gated recurrent language model and a smoothed unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gru import WINDOW, Gru
from .shared import crc_fold, drop, lean, materialise, partitions_for, read
from .words import mix, pieces, slices, text_buffers

#: Bytes of text a chunk, and bytes a task holds to put documents of like length into one chunk.
CHUNK_BYTES, HOLD_BYTES = 6 << 20, 18 << 20
#: Words the network tells apart; documents that start its training on the driver, how often, and the most tokens that
#: each gives every time.
VOCAB, WARM_DOCS, WARM_EPOCHS, WARM_TOKENS = 2046, 2000, 4, 4 * WINDOW
#: Rate of the pass over the whole corpus, and training tokens from which on it takes another copy of the network.
RATE, SHARD_TOKENS = 0.05, 1 << 21
SMOOTH = 0.1
FOLDS = 10


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of some documents each: chunk, ids, learn, sizes and sums (of words and of their hashes, a document each), the
    distinct words' hashes in ascending order, how often the learned documents have each, and the place of every word
    among them. Documents of like length lie together. Texts are split into words here alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal k
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = np.diff(text_buffers(table.column("text"))[1])
            table = table.take(pa.array(np.argsort(lengths, kind="stable")))
            _, offs = text_buffers(table.column("text"))
            for i, j in slices(offs, CHUNK_BYTES):
                rows = table.slice(i, j - i).combine_chunks()
                learn = rows.column("learn").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
                hashes, offsets = _concat(pa.RecordBatch.from_arrays([rows.column("text").combine_chunks()], names=["text"]))
                found, back = np.unique(hashes, return_inverse=True)
                counts = np.bincount(back, np.repeat(learn, np.diff(offsets)), len(found)).astype(np.int64)
                upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))[offsets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([(part << 32) + k]),
                        "ids": _row(rows.column("doc_id").combine_chunks()),
                        "learn": _row(pa.array(learn)),
                        "sizes": _row(pa.array(np.diff(offsets))),
                        "sums": _row(pa.array(np.diff(upto).view(np.int64))),
                        "hashes": pa.array([found.tobytes()], pa.binary()),
                        "counts": pa.array([_narrow(counts)], pa.binary()),
                        "places": pa.array([_narrow(back)], pa.binary()),
                    }
                )
                k += 1

        for batch in batches:
            for i, j in slices(text_buffers(batch.column("text"))[1], CHUNK_BYTES):
                piece = batch.slice(i, j - i)
                held.append(piece)
                size += int(np.diff(text_buffers(piece.column("text"))[1]).sum())
                if size >= HOLD_BYTES:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", FOLDS) != 0).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "chunk long, ids array<long>, learn array<boolean>, sizes array<long>, sums array<long>, hashes binary, counts binary, places binary"
    return materialise(rows.mapInArrow(lean(run), schema), "lm-chunks")


def _row(values: pa.Array) -> pa.Array:
    """One row with these values as its list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in two or four bytes each, or in three: all the low two bytes, then all the third ones."""
    most = int(numbers.max(initial=0))
    if most < 1 << 16:
        return numbers.astype("<u2").tobytes()
    if most < 1 << 24:
        return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype(np.uint8).tobytes()
    return numbers.astype("<u4").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    """The n numbers that ``_narrow`` wrote."""
    if len(data) == 3 * n:
        return np.frombuffer(data, "<u2", n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


@dataclass
class Chunk:
    """A row of chunks: which of its documents are learned from, where each one's words begin, the hashes of its distinct
    words and how often learned documents have them, and the place of every word among these."""

    ids: pa.Array
    learn: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, r: int) -> Chunk:
        values = lambda name: batch.column(name)[r].values
        hashes = np.frombuffer(batch.column("hashes")[r].as_buffer(), np.uint64)
        offsets = np.concatenate(([0], np.cumsum(values("sizes").to_numpy())))
        return cls(
            values("ids"),
            values("learn").to_numpy(zero_copy_only=False).astype(bool),
            offsets,
            values("sums").to_numpy().view(np.uint64),
            hashes,
            _wide(batch.column("counts")[r].as_buffer(), len(hashes)),
            _wide(batch.column("places")[r].as_buffer(), int(offsets[-1])),
        )


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each chunk, by hash, and how often its learned documents have them."""
    for batch in batches:
        for r in range(batch.num_rows):
            chunk = batch.column("chunk")[r].as_py()
            found = np.frombuffer(batch.column("hashes")[r].as_buffer(), np.int64)
            n = _wide(batch.column("counts")[r].as_buffer(), len(found))
            for i in range(0, len(found), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[part]), chunk)), pa.array(found[part]), pa.array(n[part])], names=["chunk", "h", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In one row for each chunk its words that another chunk has too, with their counts in the whole corpus."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h.view(np.uint64))
        return pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int64()), "shared": pa.array([h[order].tobytes()], pa.binary()), "total": pa.array([c[order].tobytes()], pa.binary())})

    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        columns = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("h", "c")]
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if chunk[a] != now:
                if held:
                    yield out()
                now, held = int(chunk[a]), []
            held.append([x[a:b].copy() for x in columns])
    if held:
        yield out()


@dataclass
class Model:
    """The network, the hashes of its words in ascending order with their tokens, and the corpus's counts."""

    net: Gru
    hashes: np.ndarray
    tokens: np.ndarray
    n: int
    distinct: int
    n_end: int
    n_rare: int
    distinct_rare: int

    def token_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.tokens[at], 1)

    @staticmethod
    def ended(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of documents with an end after each, and where each begins."""
        docs = len(offsets) - 1
        begins = offsets + np.arange(docs + 1)
        out = np.zeros(begins[-1], tokens.dtype)
        inner = np.ones(len(out), bool)
        inner[begins[1:] - 1] = False
        out[inner] = tokens
        return out, begins

    def encode(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ended(self.token_ids(hashes), offsets)

    def rare(self, c: np.ndarray) -> np.ndarray:
        """Natural log probability of a word outside the vocabulary, given that it is one."""
        return np.log((c + SMOOTH) / (self.n_rare + SMOOTH * (self.distinct_rare + 1)))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.n + SMOOTH * (self.distinct + 1)))


def _concat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch's texts, and where each document's begin."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, words in pieces(batch, lower=True):
        found.append(words.hashes)
        counts.append(np.diff(words.offsets))
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _tokens(batches: Iterator[pa.RecordBatch], model: Model, shards: int) -> Iterator[pa.RecordBatch]:
    """The tokens of every training document, whole, with its shard and its place in it, which its id and words give."""
    kind = np.uint16 if VOCAB + 2 <= 1 << 16 else np.uint32
    for batch in batches:
        for r in range(batch.num_rows):
            chunk = Chunk.of(batch, r)
            learn, sizes = chunk.learn, np.diff(chunk.offsets)
            if not learn.any():
                continue
            names = chunk.ids.fill_null(0).to_numpy()[learn].astype(np.uint64)
            with np.errstate(over="ignore"):
                place = mix(mix(names + np.uint64(1)) + chunk.sums[learn])
            words = model.token_ids(chunk.hashes).astype(kind)[chunk.places[np.repeat(learn, sizes)]]
            tokens, begins = model.ended(words, np.concatenate(([0], np.cumsum(sizes[learn]))))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(begins * tokens.itemsize), pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays([pa.array((place % np.uint64(shards)).astype(np.int64)), pa.array((place >> np.uint64(1)).astype(np.int64)), data.cast(pa.binary())], names=["shard", "place", "tokens"])


def average(chunks: DataFrame, model: Model, seed: int) -> Gru:
    """One pass over the whole corpus: training documents are dealt into shards of about SHARD_TOKENS tokens by their
    ids and words, a copy of the network goes on learning from all windows of a shard's documents, each in order with
    the state carried on, and the copies are averaged, weighted by tokens. Shards and the order in them depend on the
    documents alone, not on partitions or tasks. Sums are made in three levels, so that no task and not the driver
    holds more than a few hundred copies of a block of weights."""
    block = 8192
    shards = max(1, -(-model.n // SHARD_TOKENS))
    sent = chunks.sparkSession.sparkContext.broadcast(model)  # VOCAB words' weights
    kind = np.uint16 if VOCAB + 2 <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        total, seen = np.zeros(len(model.net.flat())), 0
        now, held = None, []

        def learned() -> None:
            nonlocal seen
            tokens = np.concatenate(held).astype(np.int64)
            net = model.net.like(model.net.flat())
            if hasattr(model.net, "_sum"):
                net._sum = {k: v.copy() for k, v in model.net._sum.items()}
            n = net.train(tokens, np.concatenate(([0], np.cumsum([len(x) for x in held]))), seed + now, rate=RATE)
            np.add(total, net.flat().astype(np.float64) * n, out=total)
            seen += n

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("tokens"), strict=True):
                if shard != now:
                    if held:
                        learned()
                    now, held = shard, []
                held.append(np.frombuffer(data.as_buffer(), kind).copy())
        if held:
            learned()
        if seen:
            salt = TaskContext.get().partitionId() % 256
            for i in range(0, len(total), block):
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "seen": pa.array([float(seen)]), "data": pa.array([total[i : i + block].tobytes()], pa.binary())})

    def total(keys: list[str]):
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            data = sum(np.frombuffer(x) for x in sorted(pdf["data"]))  # in one order, whatever comes first
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "seen": [pdf["seen"].sum()], "data": [data.tobytes()]})

        return add

    tokens = chunks.mapInArrow(lean(lambda it: _tokens(it, sent.value, shards)), "shard long, place long, tokens binary")
    dealt = tokens.repartition(partitions_for(chunks.sparkSession), "shard").sortWithinPartitions("shard", "place", "tokens")
    parts = dealt.select("shard", "tokens").mapInArrow(lean(run), "block int, salt int, seen double, data binary")
    parts = parts.groupBy("block", "salt").applyInPandas(total(["block", "salt"]), "block int, salt int, seen double, data binary")
    rows = parts.groupBy("block").applyInPandas(total(["block"]), "block int, seen double, data binary").collect()
    if not rows:
        return model.net
    return model.net.like(np.concatenate([np.frombuffer(r["data"]) / r["seen"] for r in sorted(rows, key=lambda r: r["block"])]))


def _pieces(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """For every epoch of the warm start, up to WARM_TOKENS tokens on end of each text, from a place seeded by its id,
    and the token before them."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        sizes = text_buffers(batch.column("text"))[1]
        for i, j in slices(sizes, CHUNK_BYTES):
            tokens, begins = model.encode(*_concat(pa.RecordBatch.from_arrays([batch.column("text").slice(i, j - i)], names=["text"])))
            out: list[tuple[int, int, int, np.ndarray]] = []
            for r, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True), i):
                rng = np.random.default_rng(ids[r] % (1 << 63))
                for epoch in range(WARM_EPOCHS):
                    at = a + int(rng.random() * (max(b - a - WARM_TOKENS, 0) + 1))
                    out.append((ids[r], epoch, int(tokens[at - 1]) if at > a else 0, tokens[at : min(at + WARM_TOKENS, b)]))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "epoch", "before", "tokens"]
            )


def learn(chunks: DataFrame, docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and for each chunk its words with their counts in all training documents.

    Every word of every training document is counted; words are told apart by 64-bit hashes. The network starts from
    pieces of a bounded number of documents, whatever their length, on the driver and then learns from every token of every training document.
    """
    spark = chunks.sparkSession
    words = chunks.select("chunk", "hashes", "counts").mapInArrow(lean(_vocabulary), "chunk long, h long, n long")
    # A table of its own: a join with it can split a word that very many chunks have.
    counted = materialise(words.groupBy("h").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")), "lm-counts")
    known = counted.where("c > 0")
    sums = known.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    # A word of one chunk alone is counted there again; the others' counts travel back.
    # Merged, as the size of what comes out of Python is only guessed.
    spread = words.select("chunk", "h").join(counted.where("chunks > 1").select("h", "c").hint("merge"), "h").repartition(partitions_for(spark), "chunk").sortWithinPartitions("chunk")
    packed = materialise(spread.select("chunk", "h", "c").mapInArrow(lean(_pack), "chunk long, shared binary, total binary"), "lm-vocabulary")
    n_end = chunks.select(F.size(F.filter("learn", lambda x: x)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = known.select("c", "h").orderBy(F.desc("c"), "h").limit(VOCAB).collect()
    drop(counted)
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    counts = np.array([r["c"] for r in top], np.int64)
    order = np.argsort(hashes)
    rare = sums["n"] - int(counts.sum())
    start = Gru.fresh(np.concatenate(([n_end, rare], counts)).astype(float))
    model = Model(start, hashes[order], (np.arange(len(top)) + 2)[order], sums["n"] + n_end, sums["v"] + (n_end > 0), n_end, rare, sums["v"] - len(top))

    some = docs.where((crc_fold("doc_id", FOLDS) != 0) & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = some.withColumn("_key", F.xxhash64("text"))
    picked = keyed.select("doc_id", "_key").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_key").limit(WARM_DOCS)
    # WARM_DOCS documents at most, each once, however often its row is repeated.
    once = keyed.join(F.broadcast(picked), ["doc_id", "_key"]).dropDuplicates(["doc_id", "_key"])
    cut = once.select("doc_id", "text").mapInArrow(lean(lambda it: _pieces(it, model)), "doc_id long, epoch int, before long, tokens array<long>")
    warm = sorted(cut.collect(), key=lambda r: (r["epoch"], r["doc_id"], r["before"], r["tokens"]))
    for epoch in range(WARM_EPOCHS):
        rows = [r for r in warm if r["epoch"] == epoch]
        if rows:
            begins = np.concatenate(([0], np.cumsum([len(r["tokens"]) for r in rows])))
            model.net.train(np.concatenate([r["tokens"] for r in rows]), begins, epoch, batch=64, before=np.array([r["before"] for r in rows]))
    if model.n:
        model.net = average(chunks, model, 100)
    return model, packed


def _counts(hashes: np.ndarray, learn: np.ndarray, known: bytes | None, counts: bytes | None) -> np.ndarray:
    """Counts in the corpus of a chunk's words: those that came back, and for words of this chunk alone its own."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    found, back = np.unique(hashes, return_inverse=True)
    c = np.bincount(back, learn, len(found)).astype(np.int64)
    if known:
        c[np.searchsorted(found, np.frombuffer(known, np.uint64))] = np.frombuffer(counts, np.int64)
    return c[back]


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    end_base, known_end = float(model.base(np.array([model.n_end]))[0]), int(model.n_end > 0)
    for batch in batches:
        for r in range(batch.num_rows):
            chunk = Chunk.of(batch, r)
            c = _counts(chunk.hashes, chunk.counts, batch.column("shared")[r].as_py(), batch.column("total")[r].as_py())
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[chunk.places])))[chunk.offsets])  # noqa: B023, E731
            ids = model.token_ids(chunk.hashes)
            tokens, begins = model.ended(ids[chunk.places], chunk.offsets)
            score = model.net.score(tokens, begins) + sums(np.where(ids == 1, model.rare(c), 0.0))
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.ids,
                    pa.array(np.diff(begins)),
                    pa.array(sums((c > 0).astype(np.int64)) + known_end),
                    pa.array(sums(model.base(c)) + end_base),
                    pa.array(score / np.log(10)),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )


def score(docs: DataFrame) -> DataFrame:
    """Every document's base and model log10 probabilities: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Documents whose crc32 fold is not 0 are learned from.

    Documents are put into chunks; only a chunk's distinct words travel to be counted, and those that other chunks have
    too come back with their counts in the corpus. Null and empty texts are the end token alone. Repeated rows are learned from and scored each.
    Texts of any length are read, learned from and scored whole, the state carried from window to window.
    Nothing to learn from: the network gives every token its starting share. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    chunks = chunked(docs)
    model, packed = learn(chunks, docs)
    sent = spark.sparkContext.broadcast(model)
    both = chunks.join(packed, "chunk", "left")
    rows = both.mapInArrow(lean(lambda it: _score(it, sent.value)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
