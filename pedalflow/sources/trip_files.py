"""Trip, station, weather and directions files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

#: File names begin with year and month; from this month on they have the later columns.
LATE = "202102"


def _csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(paths, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE")


def _time(text: Column) -> Column:
    """ISO times, or month/day/year with or without seconds."""
    short = F.regexp_replace(text, r"^(\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2})$", "$1:00")
    return F.coalesce(F.try_to_timestamp(short, F.lit("M/d/yyyy H:mm:ss")), F.try_to_timestamp(text)).cast("timestamp_ntz")


def read_trips(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Trips of both eras under one set of columns; ``\\N`` and empty fields are null."""
    month = {p: "".join(c for c in p.rsplit("/", 1)[-1] if c.isdigit())[:6] for p in paths}
    out = None
    for schema, own in ((schemas.TRIPS_EARLY, [p for p in paths if month[p] < LATE]), (schemas.TRIPS_LATE, [p for p in paths if month[p] >= LATE])):
        if not own:
            continue
        raw = _csv(spark, own, T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
        rows = raw.select(*[(_time(v) if f.name.endswith("_time") else v.cast(f.dataType)).alias(f.name) for f in schema for v in [F.nullif(F.col(f.name), F.lit("\\N"))]])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], schemas.TRIPS_EARLY)


def read_stations(spark: SparkSession, path: str, data_source: str = "website") -> DataFrame:
    rows = _csv(spark, path, T.StructType(schemas.STATIONS.fields[:4]))
    return rows.withColumns({"data_source": F.lit(data_source), "normalized_id": F.when(F.col("normalized_id").rlike(r"^\d+\.\d$"), F.concat("normalized_id", F.lit("0"))).otherwise(F.col("normalized_id"))})


def read_daily_weather(spark: SparkSession, path: str, missing: float = -9999) -> DataFrame:
    """Daily observations; the sentinel of a missing value is null."""
    rows = _csv(spark, path, schemas.DAILY_WEATHER)
    return rows.withColumns({f.name: F.nullif(F.col(f.name), F.lit(float(missing))) for f in schemas.DAILY_WEATHER if isinstance(f.dataType, T.DoubleType)})


def read_legs(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.LEGS)
