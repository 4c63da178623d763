"""Snapshot collection as streams: payload files come in, deduplicated rows are appended once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.geo import grid_cell
from ..sources import feeds
from ..sources.storage import append_once

PAYLOADS = "source string, feed string, fetched_at timestamp, json string"


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Payloads dropped as JSON lines (columns as in PAYLOADS) into a folder."""
    return spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def poll_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    from .gaps import POLLS

    return spark.readStream.schema(POLLS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def rows_of(payloads: DataFrame, feed: str, cell: Column | None = None) -> tuple[str, DataFrame]:
    """The dataset that a feed fills, and its rows."""
    own = payloads.where(F.col("feed") == feed)
    if feed == "station_status":
        return feed, feeds.station_status(own)
    if feed == "station_information":
        return feed, feeds.station_information(own)
    if feed == "vehicle_types":
        return feed, feeds.vehicle_types(own)
    return "free_bike_cells", feeds.free_bike_cells(own, grid_cell(F.col("lat"), F.col("lon")) if cell is None else cell)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The name that a stream keeps with its checkpoint, whoever runs it."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def collect(payloads: DataFrame, data_dir: str, source: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends every feed's new rows of one source; a batch that is run again stores nothing twice.

    Each batch is parsed and stored by the batch writer, which leaves out keys that are on disk. Bike ids are dropped
    inside the payload before any shuffle, state, cache or sink: payloads that may hold some are not kept for the
    other feeds' sake. One query serves one source, so a source that fails leaves
    the others running.
    """

    def store(batch: DataFrame, number: int) -> None:
        name = f"{query_id(batch.sparkSession, checkpoint)}-{number}"
        own = batch.where(F.col("source") == source)
        plain = own.where(F.col("feed") != "free_bike_status").persist()
        try:
            for feed in feeds.REQUIRED:
                dataset, rows = rows_of(own if feed == "free_bike_status" else plain, feed)
                append_once(rows, data_dir, source, dataset, name)
        finally:
            plain.unpersist()

    writer = payloads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).queryName(f"collect-{source}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def store_gaps(gaps: DataFrame, data_dir: str, source: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends gap rows; one that is stored under the same feed and start stays as it is."""

    def store(batch: DataFrame, number: int) -> None:
        append_once(batch.where(F.col("source") == source), data_dir, source, "gaps", f"{query_id(batch.sparkSession, checkpoint)}-{number}")

    writer = gaps.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def once(status: DataFrame, late: str = "1 hour") -> DataFrame:
    """Station rows of a stream, each key once while it is within the watermark."""
    return status.withWatermark("snapshot_ts", late).dropDuplicatesWithinWatermark(["source", "station_id", "snapshot_ts"])


def hourly_availability(status: DataFrame, late: str = "1 hour") -> DataFrame:
    """Mean bikes a station row by closed UTC hour of a stream."""
    return once(status, late).groupBy("source", F.window("snapshot_ts", "1 hour")).agg(F.avg("num_bikes_available").alias("mean_bikes_available"), F.count("*").alias("n_rows")).select("source", F.col("window.start").alias("hour_ts"), "mean_bikes_available", "n_rows")


def empty_episodes(status: DataFrame, apart: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches in which an installed station was seen empty again and again, from a stream."""
    bare = status.withWatermark("snapshot_ts", late).where("num_bikes_available = 0 and is_installed")
    return bare.groupBy("source", "station_id", F.session_window("snapshot_ts", apart)).agg(F.count("*").alias("n_rows")).select("source", "station_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_rows")


