"""Writers: append once, write-once days, full overwrite, upsert, delete, compaction, nested JSON, CSV."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ledger, schemas
from .catalog import read_table


class InvalidSnapshot(ValueError):
    """Rows that must not be stored."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or a local one for a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pedalflow-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in order, cast; columns that are missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def checked(df: DataFrame, dataset: str, source: str) -> DataFrame:
    """The rows, as a plan that fails on a foreign source, a missing key, or an unknown gap reason."""
    wrong = F.when(~F.col("source").eqNullSafe(F.lit(source)), F.raise_error(F.concat(F.lit("foreign source: "), F.coalesce("source", F.lit("null")))))
    for key in schemas.KEYS[dataset]:
        wrong = wrong.when(F.col(key).isNull() if key.endswith(("_ts", "_start")) else F.lit(False), F.raise_error(F.lit(f"no {key}")))
    if dataset == "gaps":
        wrong = wrong.when(~F.coalesce(F.col("reason").isin(*schemas.GAP_REASONS), F.lit(False)), F.raise_error(F.concat(F.lit("gap reason: "), F.coalesce("reason", F.lit("null")))))
    return df.where(F.coalesce(wrong.cast("boolean"), F.lit(True)))


def stored_keys(spark: SparkSession, data_dir: str, source: str, dataset: str, dates: list | None = None) -> DataFrame:
    """Keys on disk, of some UTC dates only where given: a scan of the key columns of those partitions."""
    table = read_table(spark, f"{data_dir}/{source}/{dataset}", T.StructType(list(schemas.SNAPSHOTS[dataset])), True)
    if dates is not None:
        table = table.where(F.col("date").isin([F.lit(d) for d in dates]) if dates else F.lit(False))
    return table.select(*schemas.KEYS[dataset]).distinct()


def partition_dates(spark: SparkSession, path: str) -> list[date]:
    """The dates of a folder's partitions, newest first, from their names: no file is opened."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    names = (f.getPath().getName() for f in store.listStatus(place) if f.isDirectory())
    return sorted((date.fromisoformat(n[5:]) for n in names if n.startswith("date=") and n[5:6].isdigit()), reverse=True)


def latest_snapshot(spark: SparkSession, data_dir: str, source: str, dataset: str):
    """The newest stored time, from the newest partition that has any alone; None without any."""
    path = f"{data_dir}/{source}/{dataset}"
    table = read_table(spark, path, T.StructType(list(schemas.SNAPSHOTS[dataset])), True)
    for day in partition_dates(spark, path):
        newest = table.where(F.col("date") == F.lit(day)).agg(F.max(schemas.TIMES[dataset])).first()[0]
        if newest is not None:
            return newest
    return None


def latest_gap_end(spark: SparkSession, data_dir: str, source: str, feed: str):
    """The newest end of a feed's gaps, from the two newest partitions."""
    path = f"{data_dir}/{source}/gaps"
    newest = partition_dates(spark, path)[:2]
    if not newest:
        return None
    table = read_table(spark, path, T.StructType(list(schemas.SNAPSHOTS["gaps"])), True)
    return table.where(F.col("date").isin([F.lit(d) for d in newest]) & (F.col("feed") == feed)).agg(F.max("gap_end")).first()[0]


def append_once(df: DataFrame, data_dir: str, source: str, dataset: str, batch: str | None = None) -> None:
    """Appends rows whose key isn't stored yet, into UTC date partitions. Writing the same rows again adds nothing, so
    a batch that is run twice is stored once; one that has a name also if its writers overlap or die."""
    spark = df.sparkSession
    time = schemas.TIMES[dataset]
    rows = checked(conform(df, schemas.SNAPSHOTS[dataset]), dataset, source).withColumn("date", F.to_date(time)).dropDuplicates(list(schemas.KEYS[dataset])).persist()
    try:
        dates = [r[0] for r in rows.select("date").distinct().collect()]
        there = set(partition_dates(spark, f"{data_dir}/{source}/{dataset}"))
        old = [d for d in dates if d in there]
        new = rows.join(stored_keys(spark, data_dir, source, dataset, old), list(schemas.KEYS[dataset]), "left_anti") if old else rows
        ready = new.select(*schemas.SNAPSHOTS[dataset].names, "date").repartition("date").sortWithinPartitions(time)
        if batch is None:
            ready.write.mode("append").partitionBy("date").parquet(f"{data_dir}/{source}/{dataset}")
        else:
            ledger.commit_batch(ready, f"{data_dir}/{source}/{dataset}", batch)
    finally:
        rows.unpersist()


def missing_days(spark: SparkSession, data_dir: str, today: str, days_back: int) -> DataFrame:
    """Days from today - days_back to today - 2 without stored weather."""
    first, last = (date.fromisoformat(today) - timedelta(days=d) for d in (days_back, 2))
    stored = set(partition_dates(spark, f"{data_dir}/weather"))
    days = [first + timedelta(days=d) for d in range((last - first).days + 1)]
    return spark.createDataFrame([(d,) for d in days if d not in stored], "date date")


def write_days_once(hours: DataFrame, data_dir: str) -> None:
    """Weather hours of days that aren't stored yet; a stored day is never touched."""
    rows = conform(hours, schemas.WEATHER).withColumn("date", F.to_date("hour_ts"))
    stored = partition_dates(hours.sparkSession, f"{data_dir}/weather")
    new = rows.where(~F.col("date").isin([F.lit(d) for d in stored])) if stored else rows
    new.repartition("date").write.mode("append").partitionBy("date").parquet(f"{data_dir}/weather")


def write_station_areas(rows: DataFrame, data_dir: str) -> None:
    conform(rows, schemas.STATION_AREAS).coalesce(1).write.mode("overwrite").parquet(f"{data_dir}/areas/station_areas.parquet")


def compact(spark: SparkSession, data_dir: str, source: str, dataset: str, out_dir: str) -> None:
    """One sorted file a day instead of one a snapshot, so that scans skip by statistics."""
    table = read_table(spark, f"{data_dir}/{source}/{dataset}", T.StructType(list(schemas.SNAPSHOTS[dataset])), True)
    table.repartition("date").sortWithinPartitions("date", *schemas.KEYS[dataset]).write.mode("overwrite").partitionBy("date").parquet(f"{out_dir}/{source}/{dataset}")


def z_order(columns: list[Column], bits: int = 10) -> Column:
    """One number that is near where all of these bucket numbers (below 2^bits) are: their bits in turns."""
    picked = [F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1)), len(columns) * i + k) for i in range(bits) for k, c in enumerate(columns)]
    total = picked[0]
    for x in picked[1:]:
        total = total.bitwiseOR(x)
    return total


def cluster(rows: DataFrame, columns: list[str], path: str, files: int, group_bytes: int = 16 << 20, bloom: tuple[str, ...] = (), bits: int = 10) -> None:
    """Writes rows in Z-order of these columns, so that look-ups by any of them read few row groups.

    Columns are cut into 2^bits buckets at quantiles of a sketch (text by its hash, which keeps equal values together),
    and files are ranges of the interleaved numbers. ``bloom``: columns that get Bloom filters.
    """
    n = 1 << bits
    kinds = dict(rows.dtypes)
    number = {c: F.pmod(F.xxhash64(c), F.lit(1 << 40)).cast("double") if kinds[c] == "string" else (F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c)).cast("double") for c in columns}
    cuts = rows.agg(*[F.percentile_approx(number[c], F.array(*[F.lit(i / n) for i in range(1, n)]), 4 * n).alias(f"_cuts_{c}") for c in columns])
    # Cuts ascend, so a value's bucket is the number of them below it.
    placed = rows.join(F.broadcast(cuts))  # one row
    buckets = [F.coalesce(F.size(F.filter(f"_cuts_{c}", lambda cut: cut < number[c])), F.lit(0)) for c in columns]  # noqa: B023
    marked = placed.withColumn("_z", z_order(buckets, bits)).select(*rows.columns, "_z")
    writer = marked.repartitionByRange(files, "_z").sortWithinPartitions("_z", *columns).drop("_z").write.mode("overwrite").option("parquet.block.size", group_bytes)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key no new row has, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_from(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with ``columns`` from the other table where it has the key; the own values where it hasn't."""
    fresh = other.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = rows.join(fresh, key, "left")
    kept = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c in columns}
    return joined.withColumns(kept).drop("_hit", *[f"_new_{c}" for c in columns])


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """As many files as the rows have partitions, unless their number is given."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def write_nested_json(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode("overwrite").json(path)
