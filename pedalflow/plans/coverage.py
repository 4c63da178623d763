"""Full local days, and the guard that publishes nothing below fourteen of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.localtime import ZONE, local, local_date, start_of, time_of_day
from ..operators.intervals import overlap_seconds
from ..sources.catalog import Catalog

MIN_FULL_DAYS = 14
MOST_GAP_SECONDS = 3600


@dataclass(frozen=True)
class MetricResult:
    """``rows`` is a lazy frame, or None below the minimum."""

    name: str
    full_days: int
    status: str
    message: str
    rows: Any


def full_days(catalog: Catalog, zone: str = ZONE) -> DataFrame:
    """Local dates with a snapshot in their first hour and one from 23:00 on, and gaps of under an hour in total.

    Gaps of every feed count, overlapping ones each. A gap meets the local days that it touches by date, not by
    comparing it with all days.
    """
    wall = local(F.col("snapshot_ts"), zone)
    days = (
        catalog.table("station_status")
        .select(F.to_date(wall).alias("local_date"), time_of_day(wall).alias("_s"))
        .groupBy("local_date")
        .agg(F.bool_or(F.col("_s") < 3600).alias("_first"), F.bool_or(F.col("_s") >= 23 * 3600).alias("_last"))
    )
    a, b = F.col("gap_start"), F.col("gap_end")
    touched = catalog.table("gaps").where(b > a).select("gap_start", "gap_end", F.explode(F.sequence(local_date(a, zone), local_date(b, zone))).alias("local_date"))
    begin, end = start_of(F.col("local_date"), zone), start_of(F.date_add("local_date", 1), zone)
    lost = touched.groupBy("local_date").agg(F.sum(overlap_seconds(a, b, begin, end)).alias("_lost"))
    kept = days.join(lost, "local_date", "left").where(F.col("_first") & F.col("_last") & (F.coalesce("_lost", F.lit(0)) < MOST_GAP_SECONDS))
    return kept.select("local_date")


def guard(name: str, days: DataFrame | int, compute: Callable[[], Any]) -> MetricResult:
    """The computed metric, or below the minimum a result without rows; ``compute`` isn't called then."""
    n = days if isinstance(days, int) else days.count()
    if n < MIN_FULL_DAYS:
        return MetricResult(name, n, "insufficient_data", f"{n} of {MIN_FULL_DAYS} full days", None)
    return MetricResult(name, n, "ok", f"{n} full days", compute())
