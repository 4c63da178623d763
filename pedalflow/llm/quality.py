"""A byte-level convolutional quality classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_fold, lean, others, read
from .words import slices, text_buffers

#: Bytes a chunk, bytes from one chunk to the next, bytes an input step, steps a filter spans.
CHUNK, HOP, STEP, SPAN = 1024, 896, 4, 3
EMBED, FILTERS, HIDDEN = 8, 24, 16
#: Bounds of the training sample: documents of each class, and chunks of a document, spread over all of it.
TRAIN_DOCS, TRAIN_CHUNKS = 1200, 40
EPOCHS, BATCH, RATE, SEED = 12, 32, 4e-3, 11
THRESHOLD = 0.3


def chunks(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover each document whole, padded with zero bytes, and the first chunk of each
    document (one entry more than documents). An empty document has one chunk of padding."""
    length = np.diff(offs)
    counts = np.maximum(1, -(-np.maximum(length - (CHUNK - HOP), 0) // HOP))
    begins = np.concatenate(([0], np.cumsum(counts)))
    nth = np.arange(begins[-1]) - np.repeat(begins[:-1], counts)
    start = np.repeat(offs[:-1], counts) + nth * HOP
    left = np.repeat(offs[1:], counts) - start
    at = start[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < left[:, None]
    if not len(raw):
        return np.zeros(at.shape, np.uint8), begins
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)], np.uint8(0)), begins


class Net:
    """Embedding, convolution over SPAN steps of STEP bytes, ReLU, max over a chunk; largest and mean value over a
    document's chunks, a hidden layer, one probability."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = SEED) -> Net:
        rng = np.random.default_rng(seed)
        wide = STEP * EMBED
        return cls(
            {
                k: (rng.standard_normal(shape) * scale).astype(np.float32)
                for k, shape, scale in (
                    ("embed", (256, EMBED), 0.5),
                    ("conv", (wide, SPAN * FILTERS), (wide * SPAN) ** -0.5),
                    ("conv_b", (FILTERS,), 0.0),
                    ("hidden", (2 * FILTERS, HIDDEN), (2 * FILTERS) ** -0.5),
                    ("hidden_b", (HIDDEN,), 0.0),
                    ("out", (HIDDEN,), HIDDEN**-0.5),
                    ("out_b", (1,), 0.0),
                )
            }
        )

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest filter value of each chunk, its place, and the embedded input."""
        n, steps = len(block), CHUNK // STEP
        x = self.w["embed"][block].reshape(n * steps, STEP * EMBED)
        y = (x @ self.w["conv"]).reshape(n, steps, SPAN, FILTERS)
        out = steps - SPAN + 1
        z = y[:, :out, 0].copy()
        for k in range(1, SPAN):
            z += y[:, k : k + out, k]
        where = z.argmax(axis=1) if self._train else None
        best = z.max(axis=1) + self.w["conv_b"]
        return np.maximum(best, 0), where, x

    _train = False

    def head(self, top: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features = np.concatenate((top, mean), axis=1)
        hidden = np.maximum(features @ self.w["hidden"] + self.w["hidden_b"], 0)
        return hidden @ self.w["out"] + self.w["out_b"][0], hidden, features

    def logits(self, raw: np.ndarray, offs: np.ndarray, block_chunks: int = 512) -> np.ndarray:
        """One value a document; blocks of chunks go through the filters, documents are combined after."""
        out = []
        for i, j in slices(offs, block_chunks * HOP):
            block, begins = chunks(raw, offs[i : j + 1])
            pooled = np.concatenate([self.pooled(block[k : k + block_chunks])[0] for k in range(0, len(block), block_chunks)])
            top = np.maximum.reduceat(pooled, begins[:-1])
            mean = np.add.reduceat(pooled, begins[:-1]) / np.diff(begins)[:, None].astype(np.float32)
            out.append(self.head(top, mean)[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def step(self, block: np.ndarray, begins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss on some documents."""
        self._train = True
        pooled, where, x = self.pooled(block)
        self._train = False
        counts = np.diff(begins)
        top = np.maximum.reduceat(pooled, begins[:-1])
        mean = np.add.reduceat(pooled, begins[:-1]) / counts[:, None].astype(np.float32)
        logit, hidden, features = self.head(top, mean)
        d_logit = ((1 / (1 + np.exp(-logit)) - labels) * weight / len(labels)).astype(np.float32)
        g = {"out": hidden.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_hidden = np.outer(d_logit, self.w["out"]) * (hidden > 0)
        g["hidden"], g["hidden_b"] = features.T @ d_hidden, d_hidden.sum(axis=0)
        d_features = d_hidden @ self.w["hidden"].T
        whose = np.repeat(np.arange(len(counts)), counts)
        d_pool = d_features[whose, FILTERS:] / counts[whose][:, None]
        d_pool += d_features[whose, :FILTERS] * (pooled == top[whose])
        d_pool *= pooled > 0
        g["conv_b"] = d_pool.sum(axis=0)
        steps, wide = CHUNK // STEP, STEP * EMBED
        base = np.arange(len(block))[:, None] * steps + where
        conv, g_conv, g_embed = self.w["conv"], np.zeros_like(self.w["conv"]), np.zeros_like(self.w["embed"])
        bytes_of = block.reshape(-1, STEP)
        for k in range(SPAN):
            rows = x[base + k]  # chunk, filter, inputs
            g_conv[:, k * FILTERS : (k + 1) * FILTERS] = np.einsum("cfi,cf->if", rows, d_pool, optimize=True)
            d_rows = (d_pool[:, :, None] * conv[:, k * FILTERS : (k + 1) * FILTERS].T).reshape(-1, wide)
            which = bytes_of[(base + k).ravel()]
            for s in range(STEP):
                for e in range(EMBED):
                    g_embed[:, e] += np.bincount(which[:, s], d_rows[:, s * EMBED + e], 256).astype(np.float32)
        g["conv"], g["embed"] = g_conv, g_embed
        return g


def train(cut: list[np.ndarray], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """A net fitted with Adam on texts of both classes, as their chunks; the classes weigh the same, and the bias then
    takes up the prior."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    t, total = 0, epochs * -(-len(cut) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            begins = np.concatenate(([0], np.cumsum([len(cut[p]) for p in pick])))
            grads = net.step(np.concatenate([cut[p] for p in pick]), begins, labels[pick], weight[pick])
            t += 1
            rate = RATE * (1 - t / (total + 1))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    net.w["out_b"] += np.float32(np.log(prior / (1 - prior)))
    return net


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to TRAIN_CHUNKS chunks of each text, from its first to its last."""
    for batch in batches:
        raw, offs = text_buffers(batch.column("text"))
        for i, j in slices(offs):
            block, begins = chunks(raw, offs[i : j + 1])
            found = []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                pick = np.arange(a, b) if b - a <= TRAIN_CHUNKS else np.linspace(a, b - 1, TRAIN_CHUNKS).astype(np.int64)
                found.append(block[pick].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("quality").slice(i, j - i), pa.array(found, pa.binary())], names=["doc_id", "quality", "chunks"])


def learn(docs: DataFrame, labels: DataFrame) -> Net | float:
    """A net from rows whose crc32 fold is not 0. The sample is bounded: of each class the TRAIN_DOCS labelled ids with a
    text that come first by hash, of each one text (that of the smallest hash where an id repeats) and of a long text
    TRAIN_CHUNKS chunks all over it. The prior counts all labels to learn from. With one class only, its
    Laplace-smoothed share is all there is to learn."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold("doc_id", 5) != 0))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return prior
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_t"))
    usable = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(texts.groupBy("doc_id").agg(F.min("_t").alias("_t")), "doc_id")
    parts = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for q in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    rows = texts.join(F.broadcast(picked), ["doc_id", "_t"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")  # at most 2 * TRAIN_DOCS ids
    rows = rows.mapInArrow(lean(_samples), "doc_id long, quality int, chunks binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["chunks"]))
    found = np.array([r["quality"] for r in rows])
    if len(set(found.tolist())) < 2:
        return prior
    return train([np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in rows], found, prior)


def score(docs: DataFrame, net: Net | float) -> DataFrame:
    """The rows of docs with ``score``, the probability that the whole text is good.

    Every byte of a text is in some chunk. Null and empty texts are one chunk of padding. Columns of docs that are
    called ``score``, in any case, are replaced; repeated rows are scored each; an empty table gives no rows.
    """
    kept = others(docs.columns, "score")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "text")
    if not isinstance(net, Net):
        return rows.select("row.*", F.lit(float(net)).alias("score"))
    weights = net.w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net(weights)
        for batch in batches:
            raw, offs = text_buffers(batch.column("text"))
            logit = own.logits(raw, offs).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))))], names=["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(run), schema).select("row.*", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = learn(docs, read(spark, sf_dir, "labels"))
    ids = docs.select(F.struct("doc_id").alias("id"), "text")
    return score(ids, net).select(
        "id.doc_id", (crc_fold("id.doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
