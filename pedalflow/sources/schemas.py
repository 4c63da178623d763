"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(18_3)": T.DecimalType(18, 3),
    "decimal(9_6)": T.DecimalType(9, 6),
    "vehicle_counts": T.ArrayType(T.StructType([T.StructField("vehicle_type_id", T.StringType()), T.StructField("count", T.IntegerType())])),
}


def _schema(columns: str) -> T.StructType:
    """Names and kinds, which need no running session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


VEHICLE_COUNTS = "array<struct<vehicle_type_id: string, count: int>>"

#: Snapshot tables of one source; `date` is the UTC date of snapshot_ts, of gap_start for gaps.
SNAPSHOTS = {
    "station_status": _schema(
        "snapshot_ts timestamp, fetched_at timestamp, source string, station_id string, num_bikes_available int, num_docks_available int, "
        "num_bikes_disabled int, is_installed boolean, is_renting boolean, is_returning boolean, last_reported timestamp, "
        "vehicle_types_available vehicle_counts"
    ),
    "station_information": _schema("snapshot_ts timestamp, source string, station_id string, name string, lat double, lon double, capacity int"),
    "vehicle_types": _schema("snapshot_ts timestamp, source string, vehicle_type_id string, form_factor string, propulsion_type string, name string"),
    "free_bike_cells": _schema(
        "snapshot_ts timestamp, fetched_at timestamp, source string, cell string, vehicle_type_id string, at_station boolean, num_bikes int, "
        "num_disabled int, num_reserved int"
    ),
    "gaps": _schema("source string, feed string, gap_start timestamp, gap_end timestamp, reason string, attempts int"),
}
WEATHER = _schema("hour_ts timestamp, precipitation_mm double, temperature_c double, condition string")
STATION_AREAS = _schema("source string, station_id string, bezirk string, ortsteil string")

#: What names a row of a snapshot table, and the time it is filed under.
KEYS = {
    "station_status": ("station_id", "snapshot_ts"),
    "station_information": ("station_id", "snapshot_ts"),
    "vehicle_types": ("vehicle_type_id", "snapshot_ts"),
    "free_bike_cells": ("cell", "vehicle_type_id", "at_station", "snapshot_ts"),
    "gaps": ("feed", "gap_start"),
}
TIMES = {name: "gap_start" if name == "gaps" else "snapshot_ts" for name in SNAPSHOTS}
GAP_REASONS = ("fetch_error", "collector_down", "stale_feed")

_TRIP_ENDS = (
    "start_time timestamp_ntz, stop_time timestamp_ntz, start_station_id string, start_station_name string, start_station_latitude double, "
    "start_station_longitude double, end_station_id string, end_station_name string, end_station_latitude double, end_station_longitude double"
)
#: Trip files up to January 2021 and from then on.
TRIPS_EARLY = _schema(f"trip_duration decimal(18_3), {_TRIP_ENDS}, bike_id int, user_type string, birth_year string, gender string")
TRIPS_LATE = _schema(
    "ride_id string, rideable_type string, start_time timestamp_ntz, stop_time timestamp_ntz, start_station_name string, start_station_id string, "
    "end_station_name string, end_station_id string, start_station_latitude double, start_station_longitude double, end_station_latitude double, "
    "end_station_longitude double, user_type string"
)
STATIONS = _schema("normalized_id string, name string, latitude double, longitude double, data_source string")
DAILY_WEATHER = _schema(
    "station string, date date, precipitation double, snow_depth double, snowfall double, max_temperature double, min_temperature double, average_wind_speed double"
)
LEGS = _schema(
    "id int, direction_id int, start_station_id string, end_station_id string, number int, start_latitude decimal(9_6), start_longitude decimal(9_6), "
    "end_latitude decimal(9_6), end_longitude decimal(9_6), duration decimal(9_6)"
)
