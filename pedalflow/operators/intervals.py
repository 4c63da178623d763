"""Sets of intervals: islands of overlapping ones, overlap by one look-up, trailing distinct counts, holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.localtime import seconds_between
from .asof import asof_left
from .scan import neighbours, running


def islands(gaps: DataFrame, key: str, split: int | None = None) -> DataFrame:
    """The union of a key's gaps as disjoint ones: key, gap_start, gap_end. Gaps that only touch stay apart; one that
    ends before it starts is none.

    A gap begins an island if no earlier one ends after its start; the island ends where the farthest of its gaps
    does, which the next island's beginning sees as the farthest end before it.
    """
    own = gaps.where("gap_end >= gap_start").select(key, "gap_start", "gap_end").distinct()
    first = running(own, [key], ["gap_start", "gap_end"], "gap_end", "_reach", "max", current=False, split=split).where("_reach is null or gap_start >= _reach")
    ends = neighbours(first, [key], ["gap_start", "gap_end"], after={"_end": "_reach"}, split=split)
    farthest = own.groupBy(F.col(key).alias("_key")).agg(F.max("gap_end").alias("_last"))
    return ends.join(farthest, F.col(key).eqNullSafe(F.col("_key"))).select(key, "gap_start", F.coalesce("_end", "_last").alias("gap_end"))


def without_overlap(rows: DataFrame, gaps: DataFrame, key: str, start: str, end: str, split: int | None = None) -> DataFrame:
    """Rows that no gap of the same ``key`` overlaps (gap_start < end and gap_end > start).

    Of disjoint islands the last one that starts before a row's end reaches farthest, so it alone is asked whether it
    ends after the row's start.
    """
    met = islands(gaps, key, split).withColumnsRenamed({"gap_start": "_gap_start", "gap_end": "_gap_end"})
    found = asof_left(rows, met, [key], end, "_gap_start", ["_gap_end"], strict=True, split=split)
    return found.where(F.col("_gap_end").isNull() | (F.col("_gap_end") <= F.col(start))).drop("_gap_end")


def overlap_seconds(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), seconds_between(F.greatest(start, other_start), F.least(end, other_end)))


def trailing_distinct(rows: DataFrame, day: str, ident: str, days: int, name: str, calendar: tuple[str, str] | None = None) -> DataFrame:
    """For each day, how many distinct idents came in the ``days`` days that end with it; days without any are left
    out. Without a calendar, days from the first to the last of the data.

    A sighting counts for an ident until its window ends or the next sighting takes over, so every ident is counted
    once a day: each stretch adds one at its start and takes one away after its end, and the running sum over days is
    the answer. Nothing is spread over the window and no day is joined with those before it.
    """
    once = rows.select(F.to_date(day).alias("_day"), F.col(ident).alias("_ident")).where("_day is not null and _ident is not null").distinct()
    after = F.lead("_day").over(Window.partitionBy("_ident").orderBy("_day"))
    stretches = once.withColumn("_end", F.least(F.date_add("_day", days), after))
    steps = stretches.select("_day", F.explode(F.array(F.struct(F.col("_day").alias("date"), F.lit(1).alias("d")), F.struct(F.col("_end").alias("date"), F.lit(-1).alias("d")))).alias("x"))
    # From here on a row is a day.
    changes = steps.groupBy("x.date").agg(F.sum("x.d").alias("_change"), F.max("_day").alias("_seen"))
    dense = changes.agg(F.min("date").alias("a"), F.max("_seen" if calendar is None else "date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    counts = dense.join(changes, "date", "left").select("date", F.sum(F.coalesce("_change", F.lit(0))).over(Window.orderBy("date")).alias(name))
    if calendar is not None:
        counts = counts.where(F.col("date").between(F.lit(calendar[0]).cast("date"), F.lit(calendar[1]).cast("date")))
    return counts.where(F.col(name) > 0)


def holes(rows: DataFrame, key: str, time: str, most_seconds: int, split: int | None = None) -> DataFrame:
    """Stretches of more than ``most_seconds`` between neighbouring times of a key: key, gap_start, gap_end."""
    times = neighbours(rows.select(key, F.col(time).alias("gap_end")).distinct(), [key], ["gap_end"], before={"gap_start": "gap_end"}, split=split)
    return times.where(seconds_between(F.col("gap_start"), F.col("gap_end")) > most_seconds).select(key, "gap_start", "gap_end")
