"""Queries over tables that were stored and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import bridge, schemas
from ..sources.bridge import SOURCE, with_views
from ..sources.catalog import read_table
from ..sources.storage import append_once, compact, scratch, write_days_once

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return register


@query("SELECT gap_start, CAST(CASE WHEN hour(gap_start) % 2 = 0 THEN 1 ELSE 2 END AS INT) AS attempts, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT gap_start FROM gaps)", "gaps")
def gaps_stored_once(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of even hours are stored, then all of them under other attempts, twice, and the days are made one file
    each: what was stored first stays, and nothing is there twice."""
    folder = scratch(spark, "gaps")
    gaps = bridge.gaps(spark, d).withColumns({"feed": F.lit("station_status"), "reason": F.lit("fetch_error")})
    append_once(gaps.where(F.hour("gap_start") % 2 == 0).withColumn("attempts", F.lit(1)), folder, SOURCE, "gaps", batch="even")
    for batch in ("all", "again"):
        append_once(gaps.withColumn("attempts", F.lit(2)), folder, SOURCE, "gaps", batch=batch)
    compact(spark, folder, SOURCE, "gaps", f"{folder}/compact")
    stored = read_table(spark, f"{folder}/compact/{SOURCE}/gaps", T.StructType(list(schemas.SNAPSHOTS["gaps"])), True)
    return stored.groupBy(F.col("gap_start").cast("timestamp_ntz").alias("gap_start"), "attempts").agg(F.count("*").alias("n"))


@query(
    """w AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(hour_ts AS DATE)) % 2 = 0 AND bool_or(hour(hour_ts) < 12) OVER (PARTITION BY CAST(hour_ts AS DATE)) AS early FROM weather)
SELECT hour_ts, CASE WHEN early THEN temperature_c ELSE temperature_c + 100 END AS temperature_c FROM w WHERE NOT early OR hour(hour_ts) < 12""",
    "weather",
)
def weather_days_once(spark: SparkSession, d: str) -> DataFrame:
    """The mornings of even days are stored, then all days with other temperatures: a stored day is never touched.
    Even days without a morning are new to the second writing."""
    folder = scratch(spark, "weather")
    hours = bridge.weather(spark, d)
    write_days_once(hours.where((F.unix_date(F.to_date("hour_ts")) % 2 == 0) & (F.hour("hour_ts") < 12)), folder)
    write_days_once(hours.withColumn("temperature_c", F.col("temperature_c") + 100), folder)
    stored = read_table(spark, f"{folder}/weather", T.StructType(list(schemas.WEATHER)), True)
    return stored.select(F.col("hour_ts").cast("timestamp_ntz").alias("hour_ts"), "temperature_c")
