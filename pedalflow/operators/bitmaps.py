"""Exact distinct counts from bitmaps a day, which merge: over any days, with late rows, without the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days' states: of each bucket of 32,768 ids that a day has, the bits of those it has.
STATES = "date date, bucket long, bits binary"


def daily_states(rows: DataFrame, day: str, ident: str) -> DataFrame:
    """States of rows with whole-number ids, dense ones for few bytes; null days and ids take no part. Bits are set in
    the map tasks, so what is shuffled is 4 kB for each bucket, day and task, however many rows there are."""
    number = F.col(ident).cast("long")
    known = rows.select(F.to_date(day).alias("date"), number.alias("_id")).where("date is not null and _id is not null")
    return known.groupBy("date", F.bitmap_bucket_number("_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))


def merged(states: DataFrame) -> DataFrame:
    return states.groupBy("date", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def trailing_counts(states: DataFrame, days: int, name: str) -> DataFrame:
    """For each day from the first to the last, how many distinct ids the ``days`` days that end with it have; days
    without any are left out. A state serves its own and the days after it."""
    last = states.agg(F.max("date").alias("_last"))
    spread = states.join(F.broadcast(last)).select("bucket", "bits", F.explode(F.sequence("date", F.least("_last", F.date_add("date", days - 1)))).alias("date"))  # one row
    return merged(spread).groupBy("date").agg(F.sum(F.bitmap_count("bits")).alias(name))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATES).parquet(path)


def write_states(states: DataFrame, path: str) -> None:
    """Replaces the states of the days that these have; other days' files stay untouched."""
    states.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def add_late(rows: DataFrame, day: str, ident: str, path: str) -> None:
    """Merges late rows into the stored states of their own days alone; the same rows again change nothing."""
    fresh = daily_states(rows, day, ident)
    dates = [r[0] for r in fresh.select("date").distinct().collect()]
    old = read_states(rows.sparkSession, path).where(F.col("date").isin([F.lit(d) for d in dates]))
    if dates:
        write_states(merged(fresh.unionByName(old)), path)
