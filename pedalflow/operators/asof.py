"""As-of joins as one running value along time, without range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running


def asof_left(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, split: int | None = None) -> DataFrame:
    """Every left row with ``values`` of the latest right row of the same keys whose time is not later (``strict``:
    earlier); null without one.

    Both sides go into one stream that is sorted by time, right rows first where times are equal (``strict``: last);
    the last right row seen so far is the match. Of right rows with the same keys and time the one with the largest
    values counts. A key that holds much of a large input is cut along time (``scan.running``).
    """
    own = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*own).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_time).alias("_time"), F.lit(2 if strict else 0).alias("_side"), F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("_left"), F.struct(*values).alias("_right"))
    both = running(a.unionByName(b), keys, ["_time", "_side", "_right"], "_right", "_match", split=split)
    found = both.where("_side = 1")
    return found.select(*[F.col(c) if c in keys else F.col(f"_left.{c}").alias(c) for c in left.columns], *[F.col(f"_match.{v}").alias(v) for v in values])


def asof_or_earliest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """As asof_left, with the earliest non-null value of the keys where nothing came before."""
    first = right.groupBy(*keys).agg(F.expr(f"min_by({value}, {right_time}) FILTER (WHERE {value} IS NOT NULL)").alias("_first"))
    found = asof_left(left, right, keys, left_time, right_time, [value])
    return found.join(first, keys, "left").withColumn(value, F.coalesce(value, "_first")).drop("_first").select(*left.columns, value)
