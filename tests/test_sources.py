import json
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pedalflow.functions import geo, values
from pedalflow.operators.spatial import map_stations
from pedalflow.sources import feeds, schemas, storage, trip_files
from pedalflow.sources.catalog import Catalog

T0 = datetime(2026, 3, 1, 23, 50)


def status(spark, times, source="syn"):
    rows = [(t, source, s, 3) for t in times for s in ("1", "2")]
    return spark.createDataFrame(rows, "snapshot_ts timestamp, source string, station_id string, num_bikes_available int")


def test_append_once_partitions_by_utc_date_and_ignores_repeats(spark, tmp_path):
    d = str(tmp_path)
    times = [T0 + timedelta(minutes=4 * i) for i in range(5)]
    storage.append_once(status(spark, times[:3]), d, "syn", "station_status")
    storage.append_once(status(spark, times), d, "syn", "station_status")
    c = Catalog(spark, d, "syn")
    table = c.station_status
    assert table.count() == 10 and sorted(str(r.date) for r in table.select("date").distinct().collect()) == ["2026-03-01", "2026-03-02"]
    assert storage.latest_snapshot(spark, d, "syn", "station_status") == times[-1]
    assert c.between("station_status", "2026-03-02", "2026-03-02").count() == 10
    assert c.gaps.count() == 0 and c.weather.count() == 0 and c.station_areas.columns == schemas.STATION_AREAS.names
    storage.compact(spark, d, "syn", "station_status", f"{d}/compact")
    assert spark.read.parquet(f"{d}/compact/syn/station_status").count() == 10


def test_invalid_rows_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="foreign source"):
        storage.append_once(status(spark, [T0], "other"), str(tmp_path), "syn", "station_status")
    gap = spark.createDataFrame([("syn", "f", T0, T0, "because", 1)], schemas.SNAPSHOTS["gaps"])
    with pytest.raises(Exception, match="gap reason"):
        storage.append_once(gap, str(tmp_path), "syn", "gaps")


def test_latest_gap_end(spark, tmp_path):
    gaps = [("syn", "a", T0 + timedelta(days=k), T0 + timedelta(days=k, hours=1), "fetch_error", 1) for k in range(4)]
    storage.append_once(spark.createDataFrame(gaps, schemas.SNAPSHOTS["gaps"]), str(tmp_path), "syn", "gaps")
    assert storage.latest_gap_end(spark, str(tmp_path), "syn", "a") == T0 + timedelta(days=3, hours=1)
    assert storage.latest_gap_end(spark, str(tmp_path), "syn", "b") is None


def test_weather_days_are_written_once(spark, tmp_path):
    d = str(tmp_path)
    hours = lambda v: spark.createDataFrame([(datetime(2026, 3, 1, h), v) for h in range(3)], "hour_ts timestamp, precipitation_mm double")
    storage.write_days_once(hours(1.0), d)
    storage.write_days_once(hours(2.0), d)
    assert {r.precipitation_mm for r in Catalog(spark, d).weather.collect()} == {1.0}
    missing = {str(r.date) for r in storage.missing_days(spark, d, "2026-03-04", 4).collect()}
    assert missing == {"2026-02-28", "2026-03-02"}


def payload(feed, data, **more):
    return json.dumps({"last_updated": 1_772_409_000, "ttl": 60, "data": data} | more)


def frame(spark, text):
    return spark.createDataFrame([("syn", T0, text)], "source string, fetched_at timestamp, json string")


def test_feeds(spark):
    s = {"station_id": "7", "num_bikes_available": 2, "is_installed": True, "is_renting": True, "is_returning": False, "last_reported": 1_772_408_000, "vehicle_types_available": [{"vehicle_type_id": "e", "count": 1}]}
    (row,) = feeds.station_status(frame(spark, payload("station_status", {"stations": [s]}))).collect()
    assert row.snapshot_ts == datetime(2026, 3, 1, 23, 50) and row.num_docks_available is None and row.vehicle_types_available[0]["count"] == 1
    assert feeds.vehicle_types(frame(spark, payload("vehicle_types", {"vehicle_types": [{"vehicle_type_id": "e", "form_factor": "bicycle", "propulsion_type": "human"}]}))).first().name is None
    with pytest.raises(Exception, match="envelope"):
        feeds.station_status(frame(spark, json.dumps({"ttl": 1, "data": {"stations": []}}))).collect()


def test_free_bikes_keep_no_ids_and_count_each_id_once(spark):
    bike = lambda i, **k: {"bike_id": i, "lat": 52.5, "lon": 13.4, "vehicle_type_id": "e"} | k
    bikes = [bike("secret-a"), bike("secret-a", lat=10.0), bike(None), bike(None, is_disabled=True), bike("secret-b", station_id="7"), bike("secret-c", is_reserved=True)]
    rows = feeds.free_bike_cells(frame(spark, payload("free_bike_status", {"bikes": bikes})), geo.grid_cell(F.col("lat"), F.col("lon"))).collect()
    assert "secret" not in str(rows)
    assert sorted((r.at_station, r.num_bikes, r.num_disabled, r.num_reserved) for r in rows) == [(False, 4, 1, 1), (True, 1, 0, 0)]


def test_discovery_prefers_german_and_wants_all_feeds(spark):
    block = lambda tag: {"feeds": [{"name": n, "url": f"{tag}/{n}"} for n in feeds.REQUIRED]}
    found = feeds.discover(frame(spark, json.dumps({"data": {"en": block("en"), "de": block("de")}}))).collect()
    assert len(found) == 4 and all(r.url.startswith("de/") for r in found)
    assert feeds.discover(frame(spark, json.dumps({"data": {"en": block("en")}}))).first().url.startswith("en/")
    with pytest.raises(Exception, match="missing feeds"):
        feeds.discover(frame(spark, json.dumps({"data": {"en": {"feeds": []}}}))).collect()


def weather(*times):
    return json.dumps({"weather": [{"timestamp": t, "precipitation": 0.5, "temperature": None, "condition": "rain", "x": 1} for t in times], "sources": []})


def test_weather_payloads(spark):
    rows = feeds.weather_hours(frame(spark, weather("2026-10-25T02:00:00+02:00", "2026-10-25T02:00:00+01:00"))).collect()
    assert [r.hour_ts for r in rows] == [datetime(2026, 10, 25, 0), datetime(2026, 10, 25, 1)]
    assert feeds.weather_day(feeds.weather_hours(frame(spark, weather("2026-03-01T23:00:00Z", "2026-03-02T00:00:00Z"))), "2026-03-02").count() == 1
    for bad in (weather("2026-03-01T10:00:00"), weather("2026-03-01T10:30:00Z"), weather("2026-03-01T10:00:00Z", "2026-03-01T11:00:00+01:00"), "{}", weather(None)):
        with pytest.raises(Exception):
            feeds.weather_hours(frame(spark, bad)).collect()


def test_stations_need_one_polygon_in_every_layer(spark, tmp_path):
    square = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    feature = lambda name, kind, c: {"type": "Feature", "properties": {"name": name}, "geometry": {"type": kind, "coordinates": c}}
    one = [feature("A", "Polygon", [square(0, 0, 2, 2), square(0.5, 0.3, 1.0, 0.7)]), feature("B", "MultiPolygon", [[square(2, 0, 3, 2)], [square(3, 0, 4, 2)]])]
    two = [feature("A1", "Polygon", [square(0, 0, 2, 1)]), feature("A2", "Polygon", [square(0, 1, 2, 2)]), feature("B1", "Polygon", [square(2, 0, 3, 2)]), feature("B2", "Polygon", [square(3, 0, 4, 2)]), feature("X", "Polygon", [square(3.5, 0, 4, 2)])]
    layers = {}
    for layer, features in (("bezirk", one), ("ortsteil", two)):
        path = tmp_path / f"{layer}.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        layers[layer] = feeds.read_geojson(spark, str(path), "name")
    points = {"in": (0.2, 0.2), "hole": (0.7, 0.5), "part": (3.2, 1.0), "out": (9.0, 9.0), "twice": (3.7, 1.0), "edge": (2.0, 0.5)}
    stations = spark.createDataFrame([("syn", s, *p) for s, p in points.items()], "source string, station_id string, lon double, lat double")
    good, problems = map_stations(stations, layers)
    assert {(r.station_id, r.bezirk, r.ortsteil) for r in good.collect()} == {("in", "A", "A1"), ("part", "B", "B2"), ("edge", "B", "B1")}
    assert {(r.station_id, r.layer, len(r.matches)) for r in problems.collect()} == {("hole", "bezirk", 0), ("out", "bezirk", 0), ("out", "ortsteil", 0), ("twice", "ortsteil", 2)}


def test_rounding_rings_and_cells(spark):
    df = spark.createDataFrame([([[[(1.000001, 2.0), (1.000002, 2.0), (3.0, 4.0)]]],)], f"g {geo.GEOMETRY}")
    assert [(p.lon, p.lat) for p in df.select(geo.rounded_rings(F.col("g")).alias("g")).first().g[0][0]] == [(1.0, 2.0), (3.0, 4.0)]
    near = spark.createDataFrame([(52.52, 13.405), (52.5201, 13.4051), (52.53, 13.405)], "lat double, lon double").select(geo.grid_cell(F.col("lat"), F.col("lon")).alias("c"))
    a, b, c = [r.c for r in near.collect()]
    assert a == b != c


def test_trip_files_of_both_eras(spark, tmp_path):
    early, late = tmp_path / "201306-trips.csv", tmp_path / "202103-trips.csv"
    early.write_text("h" + ",h" * 14 + "\n695,2013-06-01 00:00:01,6/1/2013 0:11,444,B,40.7,-74.0,434,9,40.8,-74.1,19678,Subscriber,1983,1\n10,2013-06-01 00:00:01,2013-06-01 00:00:02,\\N,\\N,0,0,1,x,0,0,2,Customer,\\N,0\n")
    late.write_text("h" + ",h" * 12 + "\nR1,classic,2021-03-01 08:00:00,2021-03-01 08:10:00,A,5382.1,B,72.00,40.1,-74.1,40.2,-74.2,member\n")
    rows = trip_files.read_trips(spark, [str(early), str(late)])
    got = {r.user_type: r for r in rows.collect()}
    assert got["Subscriber"].stop_time == datetime(2013, 6, 1, 0, 11) and got["Customer"].birth_year is None and got["member"].ride_id == "R1" and got["member"].bike_id is None
    from pedalflow.plans.trips import split_raw

    trips, loose = split_raw(rows)
    ids = {r.user_type: (r.start_station_id, r.end_station_id) for r in trips.collect()}
    assert ids == {"Subscriber": ("444", "434"), "member": ("5382.10", "72.00")} and [r.user_type for r in loose.collect()] == ["Customer"]


def test_station_ids_by_era(spark):
    df = spark.createDataFrame([("72.0", datetime(2020, 1, 1)), ("72.00", datetime(2020, 1, 1)), ("5382.1", datetime(2020, 1, 1)), ("5382.1", datetime(2021, 2, 1)), ("72.00", datetime(2021, 2, 1)), (None, datetime(2021, 2, 1)), ("1", None)], "id string, t timestamp_ntz")
    assert [r.x for r in df.select(values.station_id(F.col("id"), F.col("t")).alias("x")).collect()] == ["72", "72", "5382.1", "5382.10", "72.00", None, None]


def test_station_and_weather_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,name,lat,lon\n5382.1,A,40.0,-74.0\n")
    assert trip_files.read_stations(spark, str(tmp_path / "s.csv")).first().normalized_id == "5382.10"
    (tmp_path / "w.csv").write_text("station,date,p,sd,sf,mx,mn,w\nX,2013-07-01,0.1,0,0,80,70,-9999\n")
    row = trip_files.read_daily_weather(spark, str(tmp_path / "w.csv")).first()
    assert row.average_wind_speed is None and row.max_temperature == 80


def test_a_batch_counts_once_whoever_writes_it_and_dies_where(spark, tmp_path):
    from pyspark.sql import functions as F

    from pedalflow.sources import ledger

    root = str(tmp_path / "table")
    rows = lambda k: spark.range(10).select((F.col("id") + k).alias("id"), F.lit("2024-01-01").cast("date").alias("date"))
    ids = lambda: sorted(r.id for r in spark.read.schema("id long, date date").parquet(root).collect())
    assert ledger.commit_batch(rows(0), root, "q-0") and not ledger.commit_batch(rows(0), root, "q-0") and ids() == list(range(10))
    ledger.stage(rows(10), root, "q-1")  # died before its claim: the batch comes again
    assert ids() == list(range(10))
    assert ledger.commit_batch(rows(10), root, "q-1") and ids() == list(range(20))
    staged = ledger.stage(rows(20), root, "q-2")
    assert ledger.claim(spark, root, "q-2", staged) and ids() == list(range(20))  # died after its claim, here with no file moved
    assert not ledger.commit_batch(rows(20), root, "q-2") and ids() == list(range(30))
    one, two = (ledger.stage(rows(30).repartition(3), root, "q-3") for _ in range(2))  # two writers
    assert ledger.claim(spark, root, "q-3", one) and not ledger.claim(spark, root, "q-3", two)
    moved = next((tmp_path / "table" / one).rglob("*.parquet"))
    plan = json.loads((tmp_path / "table/_ledger/q-3.todo").read_text())
    (tmp_path / "table" / dict(plan["moves"])[str(moved.relative_to(root))]).parent.mkdir(parents=True, exist_ok=True)
    moved.rename(tmp_path / "table" / dict(plan["moves"])[str(moved.relative_to(root))])  # died between two renames
    assert ledger.publish(spark, root) == ["q-3"] and ledger.publish(spark, root) == [] and ids() == list(range(40))
    assert not list((tmp_path / "table").rglob("*.todo")) and not (tmp_path / "table" / one).exists()


def test_clusters_let_look_ups_skip_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 200) * 120)
    rows = spark.range(400_000).select((F.col("id") % 200).cast("string").alias("station_id"), times.alias("snapshot_ts"), (F.col("id") % 30).alias("bikes"))
    path = str(tmp_path / "z")
    storage.cluster(rows, ["station_id", "snapshot_ts"], path, files=16, group_bytes=64 << 10, bloom=("station_id",), bits=6)
    assert spark.read.parquet(path).count() == 400_000 and spark.read.parquet(path).exceptAll(rows).count() == 0
    day = (1_700_000_000 + 120 * 700, 1_700_000_000 + 120 * 900)
    groups = kept = 0
    for file in (tmp_path / "z").glob("*.parquet"):
        meta = pq.read_metadata(file)
        names = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            station, time = (meta.row_group(g).column(names[c]) for c in ("station_id", "snapshot_ts"))
            own = pq.ParquetFile(file).read_row_group(g, ["station_id", "snapshot_ts"])
            stamps = [t.timestamp() for t in (min(own["snapshot_ts"].to_pylist()), max(own["snapshot_ts"].to_pylist()))]
            groups += 1
            kept += station.statistics.min <= "77" <= station.statistics.max and "77" in set(own["station_id"].to_pylist()) and stamps[0] <= day[1] and stamps[1] >= day[0]
            assert time.num_values > 0
    assert groups >= 16 and kept <= 0.1 * groups, (kept, groups)
