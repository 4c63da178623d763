"""Known answers on the scripted city."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pedalflow.plans import metrics
from pedalflow.plans.coverage import full_days, guard
from pedalflow.sources.catalog import Catalog

from . import synthetic


@pytest.fixture(scope="module")
def city(spark):
    return Catalog(spark, source="syn", tables={k: v.cache() for k, v in synthetic.city(spark).items()})


@pytest.fixture(scope="module")
def days(city):
    return full_days(city).cache()


def test_full_days_without_the_gap_day_but_with_the_long_one(days):
    found = {r.local_date for r in days.collect()}
    assert len(found) == 27 and date(2026, 10, 14) not in found and date(2026, 10, 25) in found


def test_guard_below_the_minimum_does_not_compute():
    called = []
    short = guard("m", 13, lambda: called.append(1))
    assert short.rows is None and short.status == "insufficient_data" and not called
    assert guard("m", 14, lambda: "rows").rows == "rows"


def test_empty_minutes(city, days):
    weekdays = sum(d.local_date.weekday() <= 4 for d in days.collect())
    (row,) = metrics.empty_station_rows(city, days).collect()
    assert (row.station_id, row.ortsteil, row.empty_minutes_total) == ("EMPTY", "C1", 45.0 * weekdays)
    assert row.empty_minutes_per_day == pytest.approx(45 * weekdays / 27)


@pytest.mark.parametrize("first,last,minutes", [("07:30", "08:30", 45), ("07:30", "08:15", 30), ("08:15", "09:00", 15), ("08:30", "09:30", 0), ("06:00", "07:45", 0)])
def test_window_overlaps(city, days, first, last, minutes):
    rows = metrics.empty_station_rows(city, days, (frozenset(range(5)), first, last)).collect()
    weekdays = sum(d.local_date.weekday() <= 4 for d in days.collect())
    assert [r.empty_minutes_total for r in rows] == ([minutes * weekdays] if minutes else [])
    assert metrics.empty_station_rows(city, days, (frozenset(), first, last)).count() == 0


def test_share_empty_at_eight(city, days, spark):
    assert metrics.share_empty_rows(city, days).first()[0] == pytest.approx(1 / 5)
    for shift, want in ((-23, 0.2), (-11 * 60, None)):
        moved = dict(city.tables)
        moved["station_status"] = moved["station_status"].withColumn("snapshot_ts", F.col("snapshot_ts") + F.make_dt_interval(secs=F.lit(shift)))
        got = metrics.share_empty_rows(Catalog(spark, source="syn", tables=moved), days).first()[0]
        assert got == (None if want is None else pytest.approx(want))


def test_net_flow_and_its_split(city, days):
    net = {(r.day_type, r.local_hour, r.bezirk): r for r in metrics.net_flow_rows(city, days).collect()}
    for hour, sign in ((7, -1), (8, -1), (17, 1), (18, 1)):
        assert net["weekday", hour, "A"].net_per_day == pytest.approx(3 * sign)
        assert net["weekday", hour, "B"].net_per_day == pytest.approx(-3 * sign)
    assert net["weekday", 7, "C"].net_per_day == 0 and net["weekday", 7, "C"].gains_per_day == net["weekday", 7, "C"].losses_per_day == 5
    assert not any(k[0] == "weekend" for k in net)
    flows = {(r.local_hour, r.from_bezirk, r.to_bezirk): r.bikes_per_day for r in metrics.flow_between_rows(metrics.net_flow_rows(city, days)).collect()}
    assert flows == {(7, "A", "B"): pytest.approx(3), (8, "A", "B"): pytest.approx(3), (17, "B", "A"): pytest.approx(3), (18, "B", "A"): pytest.approx(3)}


@pytest.mark.parametrize("first,hour,n,other", [(date(2026, 10, 19), 2, 2, 1), (date(2026, 3, 23), 2, 0, 1)])
def test_repeated_and_skipped_hours(spark, first, hour, n, other):
    c = Catalog(spark, source="syn", tables=synthetic.city(spark, first, 7, gap=False))
    got = {(r.weekday, r.local_hour): r for r in metrics.availability_rows(c).collect()}
    assert (got[6, hour].n_snapshots if (6, hour) in got else 0) == 4 * n and got[5, hour].n_snapshots == 4 * other
    assert got[5, hour].mean_bikes_available == 28


def test_profiles_and_curves(city, days, spark):
    info = spark.createDataFrame(
        [("syn", s, datetime(2026, 10, 12) + timedelta(days=k), n, 1.0 + k, None if k else 2.0) for s, _, _ in synthetic.AREAS for k, n in ((0, f"old {s}"), (1, None))],
        "source string, station_id string, snapshot_ts timestamp_ntz, name string, lat double, lon double",
    )
    c = Catalog(spark, source="syn", tables=city.tables | {"station_information": info})
    rows = {(r.station_id, r.weekday, r.local_hour): r for r in metrics.station_profile_rows(c, days).collect()}
    assert len(rows) == 5 * 168
    monday = rows["EMPTY", 0, 7]
    assert monday.mean_bikes_available == 3 * 5 / 4 and rows["EMPTY", 0, 8].mean_bikes_available == 2 * 5 / 4 and rows["EMPTY", 5, 7].mean_bikes_available == 5
    assert (monday.name, monday.lat, monday.lon) == ("old EMPTY", 2.0, 2.0)
    curve = {r.station_id: r.curves for r in metrics.profile_curves(metrics.station_profile_rows(c, days), "station_id").collect()}
    assert curve["EMPTY"][0][7] == 3.8 and len(curve["EMPTY"]) == 7 and len(curve["EMPTY"][6]) == 24


def test_footprint_resolves_types_as_of_each_snapshot(spark):
    first = datetime(2026, 1, 5)
    times = [first + timedelta(days=d, minutes=m - 60) for d in range(14) for m in (30, 23 * 60 + 30)]
    status = spark.createDataFrame([("syn", "S", t, 0, True, [("LATE", 5), ("SWITCH", 7), ("EBIKE", 3), ("PEDAL", 4), ("GHOST", 2)]) for t in times], synthetic.STATUS)
    cells = spark.createDataFrame([("syn", t, "LATE", False, 6) for t in times] + [("syn", t, "EBIKE", True, 999) for t in times], "source string, snapshot_ts timestamp_ntz, vehicle_type_id string, at_station boolean, num_bikes int")
    seen = [(0, "SWITCH", "human"), (0, "EBIKE", "electric"), (0, "PEDAL", "human"), (3, "LATE", "electric_assist"), (9, "SWITCH", "electric_assist")]
    types = spark.createDataFrame([("syn", v, first + timedelta(days=d, hours=-1), k) for d, v, k in seen], "source string, vehicle_type_id string, snapshot_ts timestamp_ntz, propulsion_type string")
    c = Catalog(spark, source="syn", tables={"station_status": status, "free_bike_cells": cells, "vehicle_types": types, "gaps": spark.createDataFrame([], synthetic.GAPS)})
    rows = metrics.footprint_rows(c, full_days(c)).orderBy("local_date").collect()
    assert len(rows) == 14
    for i, r in enumerate(rows):
        assert r.mean_unknown_type == 2 and r.mean_bikes_free_floating == 6
        assert (r.mean_ebikes, r.mean_pedal_bikes) == ((14, 11) if i < 9 else (21, 4))


def test_public_metrics_apply_the_guard(city):
    assert metrics.availability_by_hour(city).rows.count() == 168
    assert metrics.net_flow_by_bezirk(city).full_days == 27
    with pytest.raises(ValueError):
        metrics.availability_rows(city, "street")
    with pytest.raises(ValueError):
        metrics.weather_rows(city, "wind")


def test_weather_buckets(spark):
    rows = [("syn", s, datetime(2026, 1, 5 + d, h), 0 if s == "E" and h == 6 else 3, True, None) for d in range(5) for h in (6, 12) for s in ("E", "F")]
    weather = [(datetime(2026, 1, 5 + d, h), 1.0 if h == 6 else 0.0, -5.0 if h == 6 else 20.0) for d in range(4) for h in (6, 12)]
    c = Catalog(spark, source="syn", tables={"station_status": spark.createDataFrame(rows, synthetic.STATUS), "weather": spark.createDataFrame(weather, "hour_ts timestamp_ntz, precipitation_mm double, temperature_c double")})
    got = {(r.bucket, r.local_hour): (r.mean_bikes_available, r.empty_station_share, r.n_snapshots, r.n_hours) for r in metrics.weather_rows(c, "rain").collect()}
    assert got == {("rainy", 7): (3.0, 0.5, 4, 4), ("dry", 13): (6.0, 0.0, 4, 4), ("excluded", None): (None, None, 2, 2)}
    wet = Catalog(spark, source="syn", tables={"station_status": spark.createDataFrame(rows, synthetic.STATUS), "weather": c.table("weather").where("precipitation_mm > 0")})
    seen = lambda catalog, kind: [(r.bucket, r.n_snapshots, r.missing) for r in metrics.weather_buckets(catalog, kind).collect()]
    assert seen(wet, "rain") == [("rainy", 4, False), ("dry", 0, True)] and seen(c, "temperature") == [("cold", 4, False), ("warm", 4, False)]
    none = Catalog(spark, source="syn", tables={"station_status": spark.createDataFrame([], synthetic.STATUS), "weather": c.table("weather").limit(0)})
    assert seen(none, "temperature") == [("cold", 0, True), ("warm", 0, True)]
    with pytest.raises(ValueError):
        metrics.weather_buckets(c, "wind")
