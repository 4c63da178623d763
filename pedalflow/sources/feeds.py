"""Feed and weather payloads as rows: envelopes are parsed with declared schemas, bad ones fail or go aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import VEHICLE_COUNTS

_STATUS = (
    "station_id: string, num_bikes_available: int, num_docks_available: int, num_bikes_disabled: int, is_installed: boolean, is_renting: boolean, "
    f"is_returning: boolean, last_reported: bigint, vehicle_types_available: {VEHICLE_COUNTS}"
)
_DATA = {
    "station_status": f"stations: array<struct<{_STATUS}>>",
    "station_information": "stations: array<struct<station_id: string, name: string, lat: double, lon: double, capacity: int>>",
    "vehicle_types": "vehicle_types: array<struct<vehicle_type_id: string, form_factor: string, propulsion_type: string, name: string>>",
    "free_bike_status": "bikes: array<struct<bike_id: string, lat: double, lon: double, vehicle_type_id: string, station_id: string, is_disabled: boolean, is_reserved: boolean>>",
}
REQUIRED = ("station_information", "station_status", "vehicle_types", "free_bike_status")


def envelope(feed: str) -> str:
    return f"last_updated bigint, ttl bigint, data struct<{_DATA[feed]}>"


def read_payloads(payloads: DataFrame, feed: str) -> DataFrame:
    """Payload rows (source, fetched_at, json) with the parsed envelope; a payload that lacks last_updated, ttl or data
    fails the query."""
    read = payloads.withColumn("e", F.from_json("json", envelope(feed)))
    bad = F.col("e").isNull() | F.col("e.last_updated").isNull() | F.col("e.ttl").isNull() | F.col("e.data").isNull()
    ok = F.when(bad, F.raise_error(F.lit(f"no valid {feed} envelope")).cast("boolean")).otherwise(F.lit(True))
    return read.where(ok).withColumn("snapshot_ts", F.timestamp_seconds("e.last_updated")).drop("json")


def station_status(payloads: DataFrame) -> DataFrame:
    rows = read_payloads(payloads, "station_status").select("snapshot_ts", "fetched_at", "source", F.explode("e.data.stations").alias("s"))
    return rows.select("snapshot_ts", "fetched_at", "source", "s.*").withColumn("last_reported", F.timestamp_seconds("last_reported"))


def station_information(payloads: DataFrame) -> DataFrame:
    return read_payloads(payloads, "station_information").select("snapshot_ts", "source", F.explode("e.data.stations").alias("s")).select("snapshot_ts", "source", "s.*")


def vehicle_types(payloads: DataFrame) -> DataFrame:
    return read_payloads(payloads, "vehicle_types").select("snapshot_ts", "source", F.explode("e.data.vehicle_types").alias("v")).select("snapshot_ts", "source", "v.*")


def cells_of(bikes: DataFrame, payload: list[str], cell: list[str]) -> DataFrame:
    """Bikes of each payload by cell: num_bikes, num_disabled, num_reserved.

    Within a payload the first row of a bike_id counts; rows without one count each. The id is used for that alone and
    is in no result. ``bikes``: payload columns, position, bike_id, cell columns, is_disabled, is_reserved.
    """
    named = bikes.where("bike_id is not null")
    first = F.row_number().over(Window.partitionBy(*payload, "bike_id").orderBy("position"))
    keep = [*payload, *cell, "is_disabled", "is_reserved"]
    once = named.withColumn("_n", first).where("_n = 1").select(*keep).unionByName(bikes.where("bike_id is null").select(*keep))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return once.groupBy(*payload, *cell).agg(F.count("*").alias("num_bikes"), flag("is_disabled").alias("num_disabled"), flag("is_reserved").alias("num_reserved"))


def free_bike_cells(payloads: DataFrame, cell: Column) -> DataFrame:
    """free_bike_status payloads as counts by cell, type and whether at a station. ``cell`` names it from lat and lon.
    Ids are dropped inside the payload's own array, so no shuffle and no checkpoint ever holds one."""
    read = read_payloads(payloads, "free_bike_status").select("snapshot_ts", "fetched_at", "source", F.col("e.data.bikes").alias("bikes"))
    ids = F.transform("bikes", lambda b: b["bike_id"])
    first = F.filter("bikes", lambda b, i: b["bike_id"].isNull() | (F.array_position(ids, b["bike_id"]) == i + 1))
    bare = F.transform(first, lambda b: b.dropFields("bike_id"))
    rows = read.withColumn("b", F.explode(bare)).select("snapshot_ts", "fetched_at", "source", "b.*")
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("int")
    keys = ["snapshot_ts", "fetched_at", "source", cell.alias("cell"), "vehicle_type_id", F.coalesce(F.col("station_id") != "", F.lit(False)).alias("at_station")]
    return rows.groupBy(*keys).agg(F.count("*").cast("int").alias("num_bikes"), flag("is_disabled").alias("num_disabled"), flag("is_reserved").alias("num_reserved"))


def discover(payloads: DataFrame, language: str = "de") -> DataFrame:
    """Discovery payloads (source, json) as (source, name, url): the wanted language's feeds, else those of the first
    language by name. A source that lacks a required feed fails."""
    parsed = payloads.select("source", F.from_json("json", "data map<string, struct<feeds: array<struct<name: string, url: string>>>>").alias("e"))
    data = F.col("e.data")
    block = F.coalesce(F.try_element_at(data, F.lit(language)), F.try_element_at(data, F.array_min(F.map_keys(data))))
    feeds = parsed.select("source", block["feeds"].alias("feeds"))
    lacking = F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), F.transform("feeds", lambda f: f["name"]))
    ok = F.when(F.size(lacking) != 0, F.raise_error(F.concat(F.lit("missing feeds: "), F.array_join(lacking, ", "))).cast("boolean")).otherwise(F.lit(True))
    return feeds.where(ok).select("source", F.inline("feeds"))


def weather_hours(payloads: DataFrame) -> DataFrame:
    """Weather payloads (json) as hours in UTC. Fails on a payload without records, on times without offset or off the
    full hour, and on an hour that comes twice in a payload."""
    schema = "weather array<struct<timestamp: string, precipitation: double, temperature: double, condition: string>>"
    read = payloads.withColumn("_payload", F.xxhash64("json")).select("_payload", F.from_json("json", schema).alias("e"))
    none = F.when(F.col("e.weather").isNull(), F.raise_error(F.lit("no weather records")).cast("boolean")).otherwise(F.lit(True))
    rows = read.where(none).select("_payload", F.inline("e.weather"))
    hour = F.to_timestamp("timestamp")
    wrong = (
        F.when(F.col("timestamp").isNull(), F.raise_error(F.lit("record without a time")))
        .when(~F.col("timestamp").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.raise_error(F.concat(F.lit("time without offset: "), F.col("timestamp"))))
        .when(F.date_trunc("HOUR", hour) != hour, F.raise_error(F.concat(F.lit("not on the hour: "), F.col("timestamp"))))
    )
    hours = rows.where(F.coalesce(wrong.cast("boolean"), F.lit(True))).select("_payload", hour.alias("hour_ts"), F.col("precipitation").alias("precipitation_mm"), F.col("temperature").alias("temperature_c"), "condition")
    twice = F.when(F.count("*").over(Window.partitionBy("_payload", "hour_ts")) > 1, F.raise_error(F.lit("an hour comes twice")).cast("boolean")).otherwise(F.lit(True))
    return hours.withColumn("_ok", twice).where("_ok").select("hour_ts", "precipitation_mm", "temperature_c", "condition").orderBy("hour_ts")


def weather_day(hours: DataFrame, day: str) -> DataFrame:
    """The hours of one UTC day."""
    start = F.lit(day).cast("date").cast("timestamp")
    return hours.where((F.col("hour_ts") >= start) & (F.col("hour_ts") < start + F.expr("INTERVAL 1 DAY")))


def read_geojson(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A FeatureCollection as (name, geometry): polygons and multipolygons alike as lists of polygons."""
    from ..functions.geo import GEOMETRY

    raw = spark.read.option("wholetext", True).text(path)
    schema = "features array<struct<properties: map<string, string>, geometry: string>>"
    features = raw.select(F.inline(F.from_json("value", schema)["features"]))
    shape = features.select(F.try_element_at("properties", F.lit(name)).alias("name"), F.get_json_object("geometry", "$.type").alias("type"), F.get_json_object("geometry", "$.coordinates").alias("c"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    rings = lambda poly: F.transform(poly, lambda ring: F.transform(ring, point))
    one = F.array(rings(F.from_json("c", "array<array<array<double>>>")))
    many = F.transform(F.from_json("c", "array<array<array<array<double>>>>"), rings)
    other = F.raise_error(F.concat(F.lit("no polygon: "), F.coalesce("type", F.lit("null")))).cast(GEOMETRY)
    return shape.select("name", F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many).otherwise(other).alias("geometry"))
