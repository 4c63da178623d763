"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise, read


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Targets of sources (columns ``weight`` and ``source_size``): shares of the total size by weight, where none is
    above ``max_epochs`` times its size and what a capped source can't take goes to the others by weight.

    A source is capped exactly when its cap per weight is at most the final level, so sources are taken in that order
    and the level after capping the first k of them is computed for every k at once; the last level that still lies
    at or above its own source's cap per weight closes the capped set. Rows here are sources, not documents.
    """
    order = Window.orderBy("_ratio", "weight", "source_size")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cap = F.col("source_size") * F.lit(max_epochs)
    found = (
        sources.withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_weights_before", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_level", (F.col("_total") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before")))
    )
    level = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    return (
        found.withColumn("_final", level)
        .withColumn(
            "target",
            F.when(F.col("_final").isNull() | (F.col("_ratio") <= F.col("_final")), F.col("_cap"))
            .otherwise(F.col("_final") * F.col("weight"))
            .cast("double"),
        )
        .drop("_cap", "_ratio", "_caps_before", "_weights_before", "_total", "_weights", "_level", "_final")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: float = 3.0,
    seed: int = 7,
    size: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How much of every document a mix by source weights takes.

    Sources weigh ``weights`` in turn, by code point, a null source last. The result has the columns ``doc_id, size,
    source_size, target, taken``, the helper columns ``source, epochs_whole`` and those in ``keep``, which should be
    narrow: they travel with every row. Every document is taken
    ``floor(target / source_size)`` times, and in a seeded order (md5 of seed and id) documents get one more
    repetition until the source's remaining words are used up; the document on that border gives only a part.

    The running sums never gather a source in one task: documents are cut into 4096 buckets by their seeded order,
    buckets are summed first, and each bucket then only needs the sum of the buckets before it.

    Null text or no words: size 0, taken 0. A row without id has its place in the order by its text. Repeated rows count
    each; ties in the order go by id, then size. Sources
    without any words have target 0. An empty table gives no rows. Other columns of docs are ignored.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    # Rows without an id are told apart by their texts, so that they don't all draw alike.
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).cast("binary"))
    rows = materialise(
        docs.select(
            "doc_id",
            "source",
            words.cast("long").alias("size"),
            draw.alias("_draw"),
            F.conv(F.substring(draw, 1, 3), 16, 10).cast("int").alias("_bucket"),
            F.coalesce("source", F.lit("")).alias("_name"),
            F.col("source").isNull().alias("_none"),
            *keep,
        ),
        "mix-sizes",
    )
    key = ["_none", "_name"]
    buckets = rows.groupBy(*key, "_bucket").agg(F.sum("size").alias("_bucket_size"))
    sources = (
        rows.groupBy(*key)
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_turn", (F.row_number().over(Window.orderBy(*key)) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_turn") + 1).cast("int")))
        .drop("_turn")
    )
    targets = (
        water_fill(sources, max_epochs)
        .withColumn("epochs_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_more", F.floor(F.col("target")).cast("long") - F.col("epochs_whole") * F.col("source_size"))
    )
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("_offset", F.coalesce(F.sum("_bucket_size").over(before), F.lit(0)))
        .join(targets, key)
        .select(*key, "_bucket", "_offset", "source_size", "target", "epochs_whole", "_more")
    )
    run = Window.partitionBy(*key, "_bucket").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_more") - F.col("_offset") - F.col("_before")
    return (
        rows.withColumn("_before", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(offsets, [*key, "_bucket"])
        .withColumn("taken", F.col("epochs_whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
        .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "epochs_whole", *keep)
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nn, coalesce(source, '') AS nm,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS draw
  FROM documents),
s AS (
  SELECT nn, nm, CAST(sum(size) AS BIGINT) AS source_size,
         [1, 2, 3][CAST((row_number() OVER (ORDER BY nn, nm) - 1) % 3 AS INT) + 1] AS w
  FROM d GROUP BY nn, nm),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
  FROM c WINDOW o AS (ORDER BY ratio, w, source_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lev, ratio) AS fin FROM l WHERE lev < ratio),
t AS (
  SELECT nn, nm, source_size, CAST(CASE WHEN fin IS NULL OR ratio <= fin THEN cap ELSE fin * w END AS DOUBLE) AS target
  FROM c LEFT JOIN f ON true),
e AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
r AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY nn, nm ORDER BY draw, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM r JOIN e USING (nn, nm)
"""
