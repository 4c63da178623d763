"""Scans along time within a key: running values and neighbours, also where one key holds most of the rows.

A window puts all rows of a key into one task. Where the input is large, its keys' rows are counted; if one has more
than a share of a task, such keys are cut into segments by quantiles of their own times, so that no group is large and
range partitions of (key, segment) are about equal; what a segment hands on to those after it is one row, which comes
back by a join with the few segments there are. Cutting reads the input several times, so that it is done only then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of input up to which one task may sort all of it, so that no key needs to be cut.
SPLIT_BYTES = 128 << 20
#: Segments for each partition: the share of a partition that a group has at most, about.
SEGMENTS = 8


def input_bytes(rows: DataFrame) -> int:
    """Size of what a plan reads, as its sources declare it: files do, rows that a program made in memory don't and
    count as none."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    unknown = int(rows.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    return sum(size for size in sizes if size < unknown)


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def uncut(rows: DataFrame, keys: Sequence[str], split: int | None = None) -> bool:
    """Whether a plain window may take each key whole: the input is small, or no key has more rows than a SEGMENTS-th of
    a partition, which a large input is counted for. ``split``: bytes up to which it is small; 0: never whole."""
    if split == 0:
        return False
    if input_bytes(rows) <= (SPLIT_BYTES if split is None else split):
        return True
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("total")).first()
    return not found["total"] or found["most"] * _partitions(rows) * SEGMENTS <= found["total"]


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, nulls too; the right side's are called ``_r_<key>``."""
    found = F.lit(True)
    for k in keys:
        found = found & left[k].eqNullSafe(right[f"_r_{k}"])
    return found


def _cuts_before(cuts: Column, value: Column, most: int) -> Column:
    """How many of at most ``most`` ascending cuts lie before a value, 0 for a null one: halving, so that a row costs the
    logarithm of the number of cuts, which grows with the partitions."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])
    # An index past the end gives null and no step.
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(0))


def with_segments(rows: DataFrame, keys: Sequence[str], time: str, partitions: int | None = None) -> DataFrame:
    """The rows with ``_segment``, range-partitioned by keys and segment.

    A key's segments ascend with time, rows of one time stay together, null times come first. A key of fewer rows than
    an eighth of a partition is one segment. The table of cuts has at most two cuts for each of the segments.
    """
    n = partitions or _partitions(rows)
    most = n * SEGMENTS
    total = rows.agg(F.count("*").alias("_total"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).join(F.broadcast(total)).where(F.col("_n") * most > F.col("_total"))  # one row
    # At most ``most`` keys.
    hot = counts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.ceil(F.col("_n") * most / F.col("_total")).alias("_parts"))
    own = rows.join(F.broadcast(hot), _same(rows, hot, keys)).groupBy(*[f"_r_{k}" for k in keys], "_parts")
    at = F.array(*[F.lit(i / most) for i in range(1, most)])
    fine = own.agg(F.percentile_approx(time, at, 20 * most).alias("_fine"))
    # Every so many-th of the fine cuts, so that a key has as many as its rows ask for.
    step = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_parts"))).cast("int")
    cuts = fine.select(*[f"_r_{k}" for k in keys], F.array_distinct(F.filter("_fine", lambda _, i: (i + 1) % step == 0)).alias("_cuts"))
    both = rows.join(F.broadcast(cuts), _same(rows, cuts, keys), "left")
    segment = _cuts_before(F.col("_cuts"), F.col(time), most).alias("_segment")
    marked = both.select(*[rows[c] for c in rows.columns], F.when(F.col("_cuts").isNotNull(), segment).otherwise(0).alias("_segment"))
    return marked.repartitionByRange(n, *keys, "_segment")


def _carried(segments: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments' rows with what ``ends`` (keys, _segment, others) has for their segment."""
    right = ends.withColumnsRenamed({k: f"_r_{k}" for k in keys} | {"_segment": "_r_segment"})
    # A row a segment that has one before it: at most twice SEGMENTS for each partition.
    joined = segments.join(F.broadcast(right), _same(segments, right, keys) & (segments["_segment"] == right["_r_segment"]), "left")
    return joined.drop(*[f"_r_{k}" for k in keys], "_r_segment")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, how: str = "last", current: bool = True, split: int | None = None) -> DataFrame:
    """The rows with the last value of ``column`` that isn't null, or the largest, among those of their keys up to each
    of them in this order, or before it. ``split``: bytes of input above which large keys are cut; 0 cuts
    them always."""
    pick = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max}[how]
    frame = (Window.unboundedPreceding, 0 if current else -1)
    if uncut(rows, keys, split):
        return rows.withColumn(name, pick(F.col(column)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)))
    parts = with_segments(rows, keys, order[0])
    inner = Window.partitionBy(*keys, "_segment")
    own = parts.withColumn("_own", pick(F.col(column)).over(inner.orderBy(*order).rowsBetween(*frame)))
    at = F.struct(*order)
    last = F.max(column) if how == "max" else F.max_by(F.when(F.col(column).isNotNull(), F.struct(column)), F.when(F.col(column).isNotNull(), at))[column]
    ends = parts.groupBy(*keys, "_segment").agg(last.alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", pick(F.col("_end")).over(before)).where("_segment > 0 and _carry is not null").drop("_end")
    both = _carried(own, carried, keys)
    value = F.greatest("_own", "_carry") if how == "max" else F.coalesce("_own", "_carry")
    return both.select(*rows.columns, value.alias(name))


def neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None, split: int | None = None) -> DataFrame:
    """The rows with columns of the row before and after each within its keys, in this order, which must be total:
    ``before`` and ``after`` name them, new name to column. Null at either end."""
    before, after = before or {}, after or {}
    if uncut(rows, keys, split):
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({n: F.lag(c).over(window) for n, c in before.items()} | {n: F.lead(c).over(window) for n, c in after.items()})
    parts = with_segments(rows, keys, order[0])
    inner = Window.partitionBy(*keys, "_segment").orderBy(*order)
    wanted = sorted({*before.values(), *after.values()})
    whole = F.struct(*wanted)
    own = parts.withColumns({"_past": F.lag(whole).over(inner), "_next": F.lead(whole).over(inner)})
    at = F.struct(*order)
    ends = parts.groupBy(*keys, "_segment").agg(F.max_by(whole, at).alias("_last"), F.min_by(whole, at).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_segment")
    carried = ends.select(*keys, "_segment", F.lag("_last").over(along).alias("_last"), F.lead("_first").over(along).alias("_first")).where("_last is not null or _first is not null")
    both = _carried(own, carried, keys)
    past, coming = F.coalesce("_past", "_last"), F.coalesce("_next", "_first")
    return both.select(*rows.columns, *[past[c].alias(n) for n, c in before.items()], *[coming[c].alias(n) for n, c in after.items()])
