"""Exact quantiles of groups from two passes, with no task that holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's ranks are off by at most its group's rows divided by this.
ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], more: Sequence[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Keys, p, value: the exact quantiles, linear between neighbours, of every group that has a value; with further
    aggregates of the same rows.

    A first pass takes a sketch of each group, which brackets every wanted rank between two values. In the second, the
    values below a bracket are only counted, in the map tasks already, and those above it dropped; of those within, six
    in ``accuracy`` of a group at most beside ties, equal ones are counted, and the running counts tell the values at
    the ranks. Of groups so small that a bracket might miss its neighbours, four times ``accuracy`` rows, all values
    are within.
    """
    near = 2 / accuracy
    cuts = [min(max(p + d, 0.0), 1.0) for p in at for d in (-near, near)]
    number = F.col(value).cast("double")
    sketch = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(number, F.array(*[F.lit(c) for c in cuts]), accuracy).alias("_cuts"), *more)
    extra = [c for c in sketch.columns if c not in (*keys, "_n", "_cuts")]
    right = sketch.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(right[f"_r_{k}"])
    source = rows.where(F.col(value).isNotNull())
    joined = source.join(right, same) if keys else source.join(F.broadcast(right))  # without keys one row
    small = F.col("_n") <= 4 * accuracy
    cut = lambda k: F.col("_cuts")[k]
    inside = [small | ((number >= cut(2 * i)) & (number <= cut(2 * i + 1))) for i in range(len(at))]
    kept = F.when(reduce(or_, inside), number)
    # What lies in no bracket is counted by the cuts below it, with its smallest value for all.
    gap = F.when(kept.isNull(), sum(((number > cut(k)).cast("int") for k in range(len(cuts))), F.lit(0)))
    counts = joined.groupBy(*keys, "_n", "_cuts", *extra, gap.alias("_gap"), kept.alias("_kept")).agg(F.count("*").alias("_c"), F.min(number).alias("_least"))
    v, low, high = F.coalesce("_kept", "_least"), (lambda i: cut(2 * i)), (lambda i: cut(2 * i + 1))
    wanted = [F.when(small | (v <= high(i)), F.struct(F.lit(i).alias("i"), F.when(small | (v >= low(i)), v).alias("v"))) for i in range(len(at))]
    asked = counts.select(*keys, "_n", *extra, "_c", F.explode(F.array_compact(F.array(*wanted))).alias("_x"))
    counts = asked.select(*keys, "_n", *extra, "_c", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v"))
    rank = F.element_at(F.array(*[F.lit(float(p)) for p in at]), F.col("_i") + 1) * (F.col("_n") - 1)
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")))
    met = counts.withColumns({"_upto": upto, "_rank": rank}).where((F.col("_upto") > F.floor("_rank")) & (F.col("_upto") - F.col("_c") <= F.ceil("_rank")))
    met = met.where("_v is not null")
    # One value, or two neighbours between which the rank lies.
    pairs = met.groupBy(*keys, "_i", "_rank", *extra).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    share = F.col("_rank") - F.floor("_rank")
    found = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b"))
    return pairs.select(*keys, F.element_at(F.array(*[F.lit(float(p)) for p in at]), F.col("_i") + 1).alias("p"), found.alias("value"), *extra)
