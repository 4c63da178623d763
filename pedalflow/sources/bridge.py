"""The engine's relations as projections of the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.localtime import hour_of
from .catalog import Catalog

SOURCE = "syn"

#: The driver's tables as declared, so that no query opens files to learn their columns.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.lit(SOURCE).alias("source"),
        F.col("user_id").alias("station_id"),
        F.col("ts").cast("timestamp_ntz").alias("snapshot_ts"),
        F.col("event_id"),
        ((F.floor(F.col("value") / 10).cast("int")) % 6).alias("num_bikes_available"),
        (F.col("event_type") != "error").alias("is_installed"),
    )


def status_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of a station in an hour, as that hour's snapshot: many stations share one."""
    rows = status(spark, sf_dir).withColumn("snapshot_ts", hour_of(F.col("snapshot_ts")))
    # One aggregate a column: fixed-width buffers stay in hash aggregation, a struct would be sorted.
    last = [F.max_by(c, "event_id").alias(c) for c in ("num_bikes_available", "is_installed")]
    return rows.groupBy("station_id", "snapshot_ts").agg(*last).select(F.lit(SOURCE).alias("source"), "station_id", "snapshot_ts", "num_bikes_available", "is_installed")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_type = 'error' AND value > 200")
    start = F.col("ts").cast("timestamp_ntz")
    return rows.select(
        F.lit(SOURCE).alias("source"), F.lit("station_status").alias("feed"), start.alias("gap_start"), (start + F.make_interval(secs=F.round("value").cast("decimal(18,6)"))).alias("gap_end")
    )


def station_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return (
        read(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.lit(SOURCE).alias("source"), F.col("c_custkey").alias("station_id"), F.col("r_name").alias("bezirk"), F.col("n_name").alias("ortsteil"))
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signup of an hour gives its weather; every seventh hour is missing."""
    rows = read(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("hour_ts", hour_of(F.col("ts")))
    hours = rows.groupBy("hour_ts").agg(F.min_by("value", "event_id").alias("v"))
    number = F.floor(F.unix_seconds(F.col("hour_ts").cast("timestamp")) / 3600)
    return hours.where(number % 7 != 0).select("hour_ts", (F.col("v") / 1000).alias("precipitation_mm"), (25 - F.col("v") / 2).alias("temperature_c"))


def vehicle_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("human", "electric_assist", "electric", "cargo")]), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").where("event_type = 'signup'").select(
        F.lit(SOURCE).alias("source"), (F.col("user_id") % 20).alias("vehicle_type_id"), F.col("ts").cast("timestamp_ntz").alias("snapshot_ts"), kind.alias("propulsion_type")
    )


def free_bike_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_type = 'click'").select(
        F.lit(SOURCE).alias("source"),
        hour_of(F.col("ts")).alias("snapshot_ts"),
        (F.col("user_id") % 50).alias("cell"),
        (F.col("user_id") % 25).alias("vehicle_type_id"),
        (F.col("event_id") % 3 == 0).alias("at_station"),
        (1 + F.floor(F.col("value") / 50)).cast("int").alias("num_bikes"),
    )


def station_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sightings of each station; the later one lacks some names, so each column's newest known value differs."""
    rows = read(spark, sf_dir, "customer")
    key, x, y = F.col("c_custkey").alias("station_id"), (F.col("c_custkey") % 100) / 10, (F.col("c_custkey") % 37) / 10
    first = rows.select(F.lit(SOURCE).alias("source"), key, F.lit("2024-01-01").cast("timestamp_ntz").alias("snapshot_ts"), F.col("c_name").alias("name"), y.alias("lat"), x.alias("lon"))
    new_name = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit("*")))
    return first.unionByName(rows.select(F.lit(SOURCE).alias("source"), key, F.lit("2024-01-15").cast("timestamp_ntz").alias("snapshot_ts"), new_name.alias("name"), (y + 1).alias("lat"), x.alias("lon")))


TRIP_ORDER = ("start_time", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("stop_time"),
        F.col("l_suppkey").alias("start_station_id"),
        (F.col("l_partkey") % 100).alias("end_station_id"),
        F.col("o_custkey").alias("bike_id"),
        (F.col("o_custkey") % 3).cast("int").alias("gender"),
        (1930 + F.col("o_custkey") % 70).cast("int").alias("birth_year"),
        F.when(F.col("o_orderstatus") == "F", "Customer").otherwise("Subscriber").alias("user_type"),
        "l_quantity",
        *TRIP_ORDER[1:],
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips' stations: suppliers, with their nation and region."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return (
        read(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("name"), F.col("n_name").alias("ntaname"), F.col("r_name").alias("boroname"), ((F.col("s_suppkey") % 100) / 100 - 74).alias("lon"), ((F.col("s_suppkey") % 71) / 100 + 40).alias("lat"))
    )


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather by day of order: derived from the number of orders, missing every ninth day."""
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    number = F.unix_date("date")
    return days.where(number % 9 != 0).select("date", ((number % 11) / 10).alias("precipitation"), (20 + number % 70).cast("double").alias("max_temperature"), (number % 4).cast("double").alias("snow_depth"))


RELATIONS = {
    "station_status": status,
    "gaps": gaps,
    "station_areas": station_areas,
    "weather": weather,
    "vehicle_types": vehicle_types,
    "free_bike_cells": free_bike_cells,
    "station_information": station_information,
}


def catalog(spark: SparkSession, sf_dir: str, grid: bool = False) -> Catalog:
    """All relations of the driver's tables, each planned when it is first asked for; with ``grid``, station_status on
    the hour."""
    made = RELATIONS | ({"station_status": status_grid} if grid else {})
    return Catalog(spark, source=SOURCE, tables={name: partial(make, spark, sf_dir) for name, make in made.items()})


#: The same relations for the oracle, as common table expressions.
SQL = {
    "status": """status AS (SELECT 'syn' AS source, user_id AS station_id, ts AS snapshot_ts, event_id,
  CAST(floor(value / 10) AS INT) % 6 AS num_bikes_available, event_type <> 'error' AS is_installed FROM events)""",
    "status_grid": """status_grid AS (SELECT 'syn' AS source, user_id AS station_id, date_trunc('hour', ts) AS snapshot_ts,
  arg_max(CAST(floor(value / 10) AS INT) % 6, event_id) AS num_bikes_available, arg_max(event_type <> 'error', event_id) AS is_installed
  FROM events GROUP BY ALL)""",
    "gaps": """gaps AS (SELECT 'syn' AS source, ts AS gap_start, ts + to_seconds(CAST(round(value) AS BIGINT)) AS gap_end
  FROM events WHERE event_type = 'error' AND value > 200)""",
    "areas": """areas AS (SELECT 'syn' AS source, c_custkey AS station_id, r_name AS bezirk, n_name AS ortsteil
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "weather": """weather AS (SELECT * FROM (SELECT hour_ts, v / 1000 AS precipitation_mm, 25 - v / 2 AS temperature_c FROM (
  SELECT date_trunc('hour', ts) AS hour_ts, arg_min(value, event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY 1))
  WHERE CAST(floor(epoch(hour_ts) / 3600) AS BIGINT) % 7 <> 0)""",
    "vehicle_types": """vehicle_types AS (SELECT 'syn' AS source, user_id % 20 AS vehicle_type_id, ts AS snapshot_ts,
  ['human', 'electric_assist', 'electric', 'cargo'][event_id % 4 + 1] AS propulsion_type FROM events WHERE event_type = 'signup')""",
    "free_cells": """free_cells AS (SELECT 'syn' AS source, date_trunc('hour', ts) AS snapshot_ts, user_id % 50 AS cell, user_id % 25 AS vehicle_type_id,
  event_id % 3 = 0 AS at_station, CAST(1 + floor(value / 50) AS INT) AS num_bikes FROM events WHERE event_type = 'click')""",
    "info": """info AS (SELECT 'syn' AS source, c_custkey AS station_id, TIMESTAMP '2024-01-01' AS snapshot_ts, c_name AS name, (c_custkey % 37) / 10 AS lat, (c_custkey % 100) / 10 AS lon FROM customer
  UNION ALL SELECT 'syn', c_custkey, TIMESTAMP '2024-01-15', CASE WHEN c_custkey % 3 <> 0 THEN c_name || '*' END, (c_custkey % 37) / 10 + 1, (c_custkey % 100) / 10 FROM customer)""",
    "trips": """trips AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS start_time, CAST(l_shipdate AS TIMESTAMP) AS stop_time, l_suppkey AS start_station_id,
  l_partkey % 100 AS end_station_id, o_custkey AS bike_id, CAST(o_custkey % 3 AS INT) AS gender, CAST(1930 + o_custkey % 70 AS INT) AS birth_year,
  CASE WHEN o_orderstatus = 'F' THEN 'Customer' ELSE 'Subscriber' END AS user_type,
  l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "stations": """stations AS (SELECT s_suppkey AS station_id, s_name AS name, n_name AS ntaname, r_name AS boroname,
  (s_suppkey % 100) / 100 - 74 AS lon, (s_suppkey % 71) / 100 + 40 AS lat
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "daily_weather": """daily_weather AS (SELECT date, (d % 11) / 10 AS precipitation, CAST(20 + d % 70 AS DOUBLE) AS max_temperature, CAST(d % 4 AS DOUBLE) AS snow_depth
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders) WHERE d % 9 <> 0)""",
}


def with_views(query: str, *names: str) -> str:
    """A query over some of these relations; its own expressions may follow as 'x AS (...) , ... SELECT'."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("," if query.lstrip()[:6].upper() != "SELECT" else "") + "\n" + query
