"""Exact top-k search by inner product over integer vectors, with norm order and Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .shared import materialise, partitions_for, read

#: Classes a candidate block and a query block hold.
BLOCK, ASK = 2048, 256
#: Parts of the rotated coordinates after which partial sums are bounded.
STAGES = (0.25, 0.5, 0.75)
#: Components that the candidate blocks of one group have together; lengths of vectors, the most frequent ones, that get
#: a rotation of their own (the others are searched unrotated, with the same results).
GROUP_CELLS, ROTATED = 1 << 21, 16


def gram(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the ROTATED most frequent vector lengths, the sum of outer products of all classes: length squared numbers
    each reach the driver."""
    lengths = [r["d"] for r in rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(ROTATED).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                x = vectors.matrix(batch.column("vec").filter(pa.array(sizes == d)), np.float64)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(d * d, d, np.int32)), "at": pa.array(np.arange(d * d)), "v": pa.array(s.ravel())})

    parts = rows.select("vec", F.size("vec").alias("d")).where(F.col("d").isin(lengths) if lengths else F.lit(False)).mapInArrow(run, "d int, at long, v double").groupBy("d", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        out.setdefault(r["d"], np.zeros(r["d"] ** 2))[r["at"]] = r["v"]
    return {d: v.reshape(d, d) for d, v in out.items()}


def rotation(sums: np.ndarray) -> np.ndarray:
    """The right singular vectors of the data, largest singular value first."""
    _, found = np.linalg.eigh(sums)
    return found[:, ::-1].copy()


class Prepared:
    """A block's integer vectors, rotated, with the length of what each stage leaves."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray | None):
        self.ints = ints.astype(np.float64)
        self.rotated = self.ints if turn is None else self.ints @ turn
        d = ints.shape[1]
        self.cuts = [0, *sorted({int(d * s) for s in STAGES if 0 < int(d * s) < d})]
        squares = self.rotated**2
        self.rest = [np.sqrt(squares[:, c:].sum(axis=1)) for c in self.cuts]


def search_block(asked: Prepared, held: Prepared, ids: np.ndarray, offs: np.ndarray, best: vectors.Best) -> None:
    """Offers a candidate block to a query block. After each stage of the rotated coordinates a pair goes when its
    partial sum plus the product of both remaining lengths is below the query's k-th best score; what is left is
    scored exactly (integers below 2**53 in double precision are exact)."""
    slack = 1e-9 * np.outer(asked.rest[0], held.rest[0]) + 1e-6
    open_ = np.outer(asked.rest[0], held.rest[0]) + slack >= best.least[:, None]
    columns = np.flatnonzero(open_.any(axis=0))
    partial = np.zeros((len(asked.ints), len(columns)))
    for k in range(1, len(asked.cuts)):
        if not len(columns):
            return
        a, b = asked.cuts[k - 1], asked.cuts[k]
        partial += asked.rotated[:, a:b] @ held.rotated[columns, a:b].T
        alive = partial + np.outer(asked.rest[k], held.rest[k][columns]) + slack[:, columns] >= best.least[:, None]
        alive &= open_[:, columns]
        open_[:, columns] = alive
        keep = alive.any(axis=0)
        columns, partial = columns[keep], partial[:, keep]
    if not len(columns):
        return
    scores = asked.ints @ held.ints[columns].T
    alive = open_[:, columns] & (scores >= best.least[:, None])
    for i in np.flatnonzero(alive.any(axis=1)).tolist():
        pick = np.flatnonzero(alive[i])
        best.add(i, scores[i, pick], columns[pick], ids, offs)


def narrow(ints: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = int(np.abs(ints).max(initial=0))
    return ints.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.int64))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for table in vectors.blocks_of(batches, BLOCK):
        sizes = table.column("d").to_numpy()
        for d in np.unique(sizes).tolist():
            own = table.filter(pa.array(sizes == d)).combine_chunks()
            ids, offs = vectors.ragged(own.column("ids").combine_chunks())
            data = vectors.pack({"ints": narrow(vectors.matrix(own.column("vec").combine_chunks(), np.int64)), "ids": ids, "offs": offs})
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "cb": pa.array([(part << 32) + k]), "grp": pa.array([(part << 32) + k // max(1, GROUP_CELLS // (BLOCK * d))]), "top": pa.array([float(own.column("norm")[0].as_py())]), "data": pa.array([data], pa.binary())})
            k += 1


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for table in vectors.blocks_of(batches, ASK):
        sizes = table.column("d").to_numpy()
        for d in np.unique(sizes).tolist():
            own = table.filter(pa.array(sizes == d)).combine_chunks()
            data = vectors.pack({"ints": narrow(vectors.matrix(own.column("vec").combine_chunks(), np.int64)), "cids": own.column("cid").to_pylist()})
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "qb": pa.array([(part << 32) + k]), "asking": pa.array([data], pa.binary())})
            k += 1


def _search(batches: Iterator[pa.RecordBatch], turns: dict[int, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by key: the candidate blocks that lie there, longest first, which are prepared once, then the query
    blocks that ask them."""
    now, held = None, []
    for batch in batches:
        for r in range(batch.num_rows):
            key, kind, d = (batch.column(c)[r].as_py() for c in ("key", "kind", "d"))
            if key != now:
                now, held = key, []
            data = vectors.unpack(batch.column("data")[r].as_py())
            if kind == 0:
                held.append((d, Prepared(data["ints"], turns.get(d)), data["ids"], data["offs"]))
                continue
            asked, cids = Prepared(data["ints"], turns.get(d)), data["cids"]
            best = vectors.Best(len(cids), k)
            known = batch.column("least")[r].as_py()
            if known is not None:  # scores that each query has k of already
                best.least = np.frombuffer(known).copy()
            for own, block, ids, offs in held:
                if own == d:
                    search_block(asked, block, ids, offs, best)
            found = [best.listed(i) for i in range(len(cids))]
            lengths = np.sqrt((asked.ints**2).sum(axis=1))
            # The smallest candidate length that can still matter to some query of the block.
            need = float(min(np.where(lengths > 0, best.least / np.maximum(lengths, 1e-300), np.where(best.least > 0, np.inf, -np.inf)), default=-np.inf))
            yield pa.RecordBatch.from_pydict(
                {
                    "qb": pa.array([batch.column("qb")[r].as_py()] * len(cids), pa.int64()),
                    "need": pa.array([need] * len(cids), pa.float64()),
                    "least": pa.array([best.least.tobytes()] + [None] * (len(cids) - 1), pa.binary()),
                    "cid": pa.array(cids, pa.string()),
                    "scores": pa.array([[int(s) for s in x] for x, _ in found], pa.list_(pa.int64())),
                    "ids": pa.array([x for _, x in found], pa.list_(pa.int64())),
                }
            )


FOUND = "qb long, need double, least binary, cid string, scores array<long>, ids array<long>"


def top_k(rows: DataFrame, scale: int = 64, k: int = vectors.K, every: int = vectors.EVERY) -> DataFrame:
    """Each query's k best rows by the inner product of the vectors floor(scale * x): query_id, rank, vec_id, score.

    Queries are the rows whose id ``every`` divides; candidates all rows but those with the query's own id. Classes
    of equal vectors are sorted by length across the cluster and packed into blocks, neighbouring blocks into groups. A
    first round pairs each query block with the block of the longest vectors only and so finds scores to beat; the
    second sends it to every group whose longest vector can still beat them. A group lies in one task, so a candidate
    block travels and is rotated once.

    Null ids or vectors, empty vectors and vectors with null or non-finite components take no part; equal rows count
    once; vectors of another length are no candidates. Scores and components must fit 53 bits. Ties go to the
    smaller id. Fewer than k candidates give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    held, found = vectors.classes(vectors.valid(rows), ints, "topk-rows", k, every)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    ready = materialise(found.withColumn("norm", norm).withColumn("d", F.size("vec")), "topk-classes")
    turns = {d: rotation(s) for d, s in gram(ready).items()}
    n = partitions_for(spark)
    by_norm = ready.select("d", "norm", "cid", "vec", "ids").repartitionByRange(n, "d", F.desc("norm"), "cid").sortWithinPartitions("d", F.desc("norm"), "cid")
    held_blocks = materialise(by_norm.mapInArrow(_candidates, "d int, cb long, grp long, top double, data binary"), "topk-candidates")
    asked = ready.where("asked").select("d", "cid", "vec").sortWithinPartitions("d")
    asked_blocks = materialise(asked.mapInArrow(_questions, "d int, qb long, asking binary"), "topk-queries")
    meta = held_blocks.groupBy("d", "grp").agg(F.max("top").alias("top"))

    def search(blocks: DataFrame, questions: DataFrame) -> DataFrame:
        """blocks: key, d, top, data; questions: key, d, qb, asking, least."""
        none = F.lit(None)
        left = blocks.select("key", F.lit(0).alias("kind"), "d", "top", none.cast("long").alias("qb"), "data", none.cast("binary").alias("least"))
        right = questions.select("key", F.lit(1).alias("kind"), "d", F.lit(0.0).alias("top"), "qb", F.col("asking").alias("data"), "least")
        ordered = left.unionByName(right).repartition(n, "key").sortWithinPartitions("key", "kind", F.desc("top"), "qb")
        return ordered.select("key", "kind", "d", "qb", "data", "least").mapInArrow(lambda it: _search(it, turns, k), FOUND)

    # The longest block of each length goes to n places, and the query blocks are dealt over these.
    longest = held_blocks.join(held_blocks.groupBy("d").agg(F.max_by("cb", F.struct("top", -F.col("cb"))).alias("cb")), ["d", "cb"])
    first = longest.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("key"), "d", "top", "data")
    dealt = asked_blocks.withColumn("key", F.pmod(F.xxhash64("qb"), F.lit(n)).cast("long")).withColumn("least", F.lit(None).cast("binary"))
    need = materialise(search(first, dealt).where("least is not null").select("qb", "need", "least"), "topk-need")
    # One row here is a pair of a query block and a group. There are few vector lengths, so the pairs are made in n shares
    # of the groups, each of which meets all query blocks (two numbers a block).
    asking = asked_blocks.select("d", "qb").join(need.select("qb", "need"), "qb").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    offered = meta.withColumn("share", F.pmod(F.xxhash64("grp"), F.lit(n)).cast("int"))
    pairs = asking.join(offered, ["d", "share"]).where(F.col("top") * (1 + 1e-9) + 1e-9 >= F.col("need")).select("qb", F.col("grp").alias("key"))
    questions = pairs.join(asked_blocks.join(need.select("qb", "least"), "qb"), "qb")
    result = search(held_blocks.withColumnRenamed("grp", "key"), questions).select("cid", "scores", "ids")
    return vectors.answers(held, result, "long", k, every)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20
"""
