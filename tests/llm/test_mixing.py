import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalflow.llm import mixing


def filled(sizes, weights, most=3.0):
    """Water-filling as the words say it: give by weight, clamp, give the excess again."""
    target, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = float(sum(sizes))
    while open_.any():
        share = left * np.where(open_, weights, 0) / sum(np.asarray(weights)[open_])
        over = open_ & (share >= most * np.asarray(sizes))
        if not over.any():
            return np.where(open_, share, target)
        target[over] = most * np.asarray(sizes)[over]
        left -= target[over].sum()
        open_ &= ~over
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1, 1000, 7, 0], [5], [0, 0], [1, 1, 1, 10**6]])
def test_water_filling(spark, sizes):
    weights = [(1, 2, 3)[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "i int, source_size long, weight int")
    got = [r.target for r in mixing.water_fill(df, 3.0).orderBy("i").collect()]
    assert got == pytest.approx(filled(sizes, weights))


def test_takes_come_to_the_target_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 5 else None, "x") for i in range(600)] + [(7, "a b c", "s0", "x")] * 3 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    out = mixing.mix(df).cache()
    assert out.count() == len(rows) and out.where("taken > 3 * size or taken < 0").count() == 0
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert r.t == int(r.g)
    again = mixing.mix(df.repartition(3)).select(*out.columns)
    assert again.exceptAll(out).count() == 0


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    df = spark.createDataFrame([(1, " \t", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2


def test_rows_without_id_spread_and_long_texts_count_whole(spark):
    rows = [(None, f"w {i}", "s") for i in range(300)] + [(1, "w " * 700_000, "t"), (2, "é\u00a0x y", "t"), (2, "é\u00a0x y", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS SIZE", "2 AS Taken")
    out = mixing.mix(df).cache()
    assert out.where("size = 700000").count() == 1 and out.where("doc_id = 2 and size = 2").count() == 2
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert r.t == int(r.g)
    assert out.exceptAll(mixing.mix(df.repartition(5)).select(*out.columns)).count() == 0
