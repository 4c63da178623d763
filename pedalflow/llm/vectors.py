"""Vector classes and blocks that both nearest-neighbour searches share.

Equal vectors are one class that carries its smallest ids, so a vector that a third of all rows hold is searched and
scored once. Classes are packed into blocks of one row each; a search then works on pairs of a query block and a
candidate block, never on pairs of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Queries are the rows whose id this divides; each gets so many neighbours.
EVERY, K = 20, 20


def valid(rows: DataFrame) -> DataFrame:
    """Rows whose vector and id are not null and whose components are all finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))


def classes(rows: DataFrame, vector: Column, name: str, k: int = K, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """Rows ``vec_id, cid, vec`` (equal rows once) and classes ``cid, vec, ids, asked``: the k + 1 smallest ids of each
    vector and whether a query has it. The limit on ids inside the window reaches the map side, so a class's rows
    never meet in one task."""
    held = materialise(
        rows.select("vec_id", vector.alias("vec")).withColumn("cid", F.md5(F.concat_ws(",", F.col("vec").cast("array<string>")).cast("binary"))), name
    )
    order = Window.partitionBy("cid").orderBy("vec_id")
    firsts = held.select("cid", "vec_id", "vec").dropDuplicates(["cid", "vec_id"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    found = firsts.groupBy("cid").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = held.where(F.col("vec_id") % every == 0).select("cid").distinct().withColumn("asked", F.lit(True))
    return held, found.join(asked, "cid", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def pack(values: dict) -> bytes:
    return pickle.dumps(values, protocol=5)


def unpack(data: bytes) -> dict:
    return pickle.loads(data)


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def matrix(column: pa.Array, kind) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


class Best:
    """For each query of a block, the k + 1 best (score, smallest id) classes so far, with all their ids."""

    def __init__(self, n: int, k: int = K):
        self.k = k + 1
        self.rows: list[list[tuple[float, int, tuple[int, ...]]]] = [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, i: int, scores: np.ndarray, which: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> None:
        """Offers candidates (places in a block) to query i."""
        if len(scores) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            keep = scores >= least
            scores, which = scores[keep], which[keep]
        row = self.rows[i]
        row += [(-s, int(flat[offs[c]]), tuple(flat[offs[c] : offs[c + 1]].tolist())) for s, c in zip(scores.tolist(), which.tolist(), strict=True)]
        row.sort()
        seen: set = set()
        row[:] = [x for x in row if not (x[1:] in seen or seen.add(x[1:]))][: self.k]
        if len(row) == self.k:
            self.least[i] = -row[-1][0]

    def listed(self, i: int) -> tuple[list, list[int]]:
        """Scores and ids of query i's k + 1 best candidates, best first, ties by id."""
        out = sorted((s, v) for s, _, ids in self.rows[i] for v in ids)[: self.k]
        return [-s for s, _ in out], [v for _, v in out]


def answers(held: DataFrame, found: DataFrame, kind: str, k: int = K, every: int = EVERY) -> DataFrame:
    """Each query's neighbours from its class's candidates (``cid, scores, ids``; several rows a class where several
    tasks found some): its own id goes, the k best stay."""
    queries = held.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "cid").distinct()
    merged = found.groupBy("cid").agg(F.flatten(F.collect_list(F.arrays_zip("scores", "ids"))).alias("all"))
    best = merged.select(
        "cid",
        F.slice(F.array_sort(F.array_distinct(F.transform("all", lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("v"))))), 1, k + 1).alias("best"),
    )
    best = materialise(best, "neighbours")  # a join with a table can split a vector that very many queries have
    own = F.filter("best", lambda x: x["v"] != F.col("query_id"))
    return (
        queries.join(best, "cid")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "x"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).cast(kind).alias("score"))
    )


def blocks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Regroups a task's rows into tables of so many rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
