"""Connected components of a graph of longs, all of it distributed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, materialise, new_path

#: Edges a task unites at once before it hands on what is left of them.
HELD_EDGES = 1 << 19
#: Edges, counted first, that one task may unite alone; more take the distributed rounds.
ALONE_EDGES = 1 << 18


class Union:
    """Union-find over longs; the smallest of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top and x != top:
            up[x] = top
            x = nxt
        return top

    def unite(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.up[b] = a
        return True

    def forest(self) -> tuple[list[int], list[int]]:
        """Every node that isn't a root, with its root."""
        nodes = [x for x, y in self.up.items() if x != y]
        return [self.root(x) for x in nodes], nodes


def edge_batch(a: Iterable[int], b: Iterable[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as a spanning forest."""
    found, n = Union(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.unite(a, b)
        n += batch.num_rows
        if n > HELD_EDGES:
            yield edge_batch(*found.forest())
            found, n = Union(), 0
    yield edge_batch(*found.forest())


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes, fewer of them: each task keeps a spanning forest of its own."""
    return edges.select("a", "b").where("a <> b").mapInArrow(_thin, "a long, b long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every node's larger neighbours go to the smallest of it and its neighbours. Small star: the same
    for its smaller neighbours and itself. A node's neighbours are never gathered: the smallest is an aggregate that
    is joined back."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        return near.where("b > a").select(F.col("m").alias("a"), "b").distinct()
    return near.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) of all nodes of the edges (a, b): a component is called by its smallest node.

    Tasks first thin their edges to forests. Up to ALONE_EDGES that are left are united by one task; more by large-star
    and small-star rounds on tables in the shared folder until a round changes nothing. Every round at least halves
    long chains, and the stars that similarity joins give settle in two or three.
    """
    spark = edges.sparkSession
    now = materialise(thinned(edges), name)
    if now.count() <= ALONE_EDGES:
        now = materialise(thinned(now.repartition(1)), name)
        return _labels(now)
    now = now.distinct()
    paths: list[str] = []

    def sign(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    before = sign(now)
    while before[0]:
        path = new_path(spark, name)
        _stars(_stars(now, True), False).write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        paths.append(path)
        if len(paths) > 2:
            drop_path(spark, paths.pop(0))
        after = sign(now)
        if after == before:
            break
        before = after
    return _labels(now)


def _labels(stars: DataFrame) -> DataFrame:
    """Nodes with their component, from edges that each lead from a component's smallest node to another of its."""
    roots = stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
