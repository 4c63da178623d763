import json
from datetime import datetime, timedelta, timezone
from itertools import pairwise
from threading import Event

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pedalflow import __main__ as main
from pedalflow.plans import models
from pedalflow.sources.catalog import Catalog
from pedalflow.sources.registry import Provider, providers
from pedalflow.streaming import collect, gaps, poller, schedule

T0 = datetime(2026, 3, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def run(*events, feed="station_status"):
    """Rows of a feed's events (seconds, what); what is the snapshot's second, None for a failure, or a mark."""
    known, rows = gaps.Feed(), []
    for t, what in events:
        mark = what if isinstance(what, str) else what[0] if isinstance(what, tuple) else None
        stored, covered = (what[1], what[2]) if isinstance(what, tuple) else (None, None)
        up = what if isinstance(what, int) else stored
        time = lambda s: None if s is None else at(s)
        frame = pd.DataFrame([(at(t), isinstance(what, int), time(up), mark, time(covered))], columns=["fetched_at", "ok", "last_updated", "mark", "covered"])
        known, found = gaps.replay(known, frame.astype({"last_updated": "datetime64[us]", "covered": "datetime64[us]"}), schedule.INTERVALS[feed])
        rows += [(int((a - T0).total_seconds()), int((b - T0).total_seconds()), why, n) for a, b, why, n in found]
    return known, rows


@pytest.mark.parametrize(
    "events,rows",
    [
        ([(0, 0), (120, None), (240, None), (360, 355)], [(0, 355, "fetch_error", 2)]),
        ([(0, 0), (120, None), (200, 0), (300, 290)], []),  # nothing was missed
        ([(50, None), (100, None), (200, 190)], [(50, 190, "fetch_error", 2)]),  # no snapshot before
        ([(0, 0), (360, 0)], []),
        ([(0, 0), (361, 0), (500, 0), (900, 0)], [(0, 361, "stale_feed", 0)]),  # once a snapshot
        ([(0, 0), (400, 0), (500, None), (700, 650)], [(0, 400, "stale_feed", 0), (500, 650, "fetch_error", 1)]),
        ([(0, 0), (400, 0), (410, 100), (900, 100)], [(0, 400, "stale_feed", 0), (400, 900, "stale_feed", 0)]),
        ([(0, 0), (120, None), (900, 10)], [(0, 10, "fetch_error", 1), (10, 900, "stale_feed", 0)]),
        ([(0, 0), (120, None), (300, "stopped")], [(0, 300, "fetch_error", 1)]),
        ([(1000, ("started", 0, None)), (1010, 0), (1100, None), (1200, 1150)], [(0, 1150, "collector_down", 1)]),
        ([(1000, ("started", 0, 300)), (1010, 1005)], [(300, 1005, "collector_down", 0)]),
        ([(1000, ("started", 0, None)), (1100, "stopped")], [(0, 1100, "collector_down", 0)]),
        ([(240, ("started", 0, None)), (250, 245)], []),
        ([(1000, ("started", None, None)), (1010, 1005)], []),
    ],
)
def test_gap_rows_of_events(events, rows):
    assert run(*events)[1] == rows


def test_daily_feeds_are_never_down_and_every_move_is_defined():
    assert run((400_000, ("started", 0, None)), (400_001, 400_000), feed="vehicle_types")[1] == []
    kinds = {"started", "failed", "newer", "same", "quiet", "stopped"}
    assert set(gaps.MOVES) == {(m, k) for m in ("clear", "failing", "down") for k in kinds}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.sampled_from(["fail", "new", "old", "started", "stopped"])), max_size=25))
def test_rows_never_lack_length_and_errors_never_overlap(steps):
    t, newest, events = 0, None, []
    for d, what in steps:
        t += d
        if what == "new":
            newest = t - 1
        events.append((t, {"fail": None, "new": newest, "old": newest if newest is not None else None}.get(what, what)))
    rows = run(*events)[1]
    assert all(a < b <= t for a, b, _, _ in rows)
    errors = sorted((a, b) for a, b, why, _ in rows if why == "fetch_error")
    assert all(x[1] <= y[0] for x, y in pairwise(errors))


def test_pauses_and_due_times():
    utc = lambda t: at(t).replace(tzinfo=timezone.utc)
    assert [schedule.pause(n, 1.0) for n in (1, 2, 3, 4, 5, 9)] == [120, 240, 480, 960, 1800, 1800]
    assert schedule.pause(5, 0.0) == 120 and schedule.pause(1, 0.0, 200) == 240 and schedule.pause(1, 0.5, 5000) == 1800
    assert schedule.retry_after("17", utc(0)) == 17 and schedule.retry_after("Sun, 01 Mar 2026 12:01:00 GMT", utc(0)) == 60
    assert schedule.retry_after("soon", utc(0)) is None and schedule.retry_after(None, utc(0)) is None
    assert schedule.due(120, utc(5)) == utc(5) and schedule.due(120, utc(5), utc(0), utc(-10), 300) == utc(290)
    assert schedule.due(120, utc(5), utc(0), retry=utc(500)) == utc(500)
    hold = schedule.due(schedule.DAY, utc(0), stored=utc(-3600))
    assert hold == datetime(2026, 3, 1, 23, tzinfo=timezone.utc) and schedule.due(schedule.DAY, utc(0), stored=utc(-86_400)) == utc(0)
    for day, hour in ((28, 2), (29, 1)):  # the clocks change on the 29th
        now = datetime(2026, 3, day, 0, tzinfo=timezone.utc)
        assert schedule.next_nightly(now) == datetime(2026, 3, day, hour, 30, tzinfo=timezone.utc)


def polls(*events, feed="station_status"):
    return [{"source": "syn", "feed": feed, "fetched_at": at(t).isoformat(), "ok": u is not None, "last_updated": None if u is None else at(u).isoformat()} for t, u in events]


def test_gap_stream_goes_on_over_batches_and_equals_the_table_form(spark, tmp_path):
    folder, data = tmp_path / "polls", str(tmp_path / "data")
    folder.mkdir()
    first, second = polls((0, 0), (120, None), (240, None)), polls((360, 355), (900, 355), (1000, 990))
    want = {(at(0), at(355), "fetch_error", 2), (at(355), at(900), "stale_feed", 0)}
    for k, part in enumerate((first, second)):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        collect.store_gaps(gaps.gap_stream(collect.poll_stream(spark, str(folder))), data, "syn", str(tmp_path / "check")).awaitTermination()
    rows = Catalog(spark, data, "syn").gaps.collect()
    assert {(r.gap_start, r.gap_end, r.reason, r.attempts) for r in rows} == want
    table = spark.read.schema(gaps.POLLS).json([str(folder / "0.json"), str(folder / "1.json")])
    assert {(r.gap_start, r.gap_end, r.reason, r.attempts) for r in gaps.gaps_of(table).collect()} == want


def test_a_feed_that_falls_silent_is_called_stale(spark, tmp_path):
    folder, data = tmp_path / "polls", str(tmp_path / "data")
    folder.mkdir()
    parts = [polls((0, 0)) + polls((0, 0), feed="free_bike_status"), polls((300, 299), feed="free_bike_status"), polls((2000, 1999), feed="free_bike_status"), polls((2100, 2099), feed="free_bike_status")]
    for k, part in enumerate(parts):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        collect.store_gaps(gaps.gap_stream(collect.poll_stream(spark, str(folder))), data, "syn", str(tmp_path / "check")).awaitTermination()
    rows = Catalog(spark, data, "syn").gaps.where("feed = 'station_status'").collect()
    assert [(r.gap_start, r.reason) for r in rows] == [(at(0), "stale_feed")] and rows[0].gap_end > at(360)


def state(spark, check, name):
    """A state variable's rows, as Spark's own reader of state shows them."""
    return spark.read.format("statestore").option("stateVarName", name).load(check).collect()


def test_state_of_gaps_goes_on_ends_and_is_forgotten(spark, tmp_path):
    folder, data, check = tmp_path / "polls", str(tmp_path / "data"), str(tmp_path / "check")
    folder.mkdir()

    def feed(number, *events):
        (folder / f"{number}.json").write_text("\n".join(map(json.dumps, events)))
        collect.store_gaps(gaps.gap_stream(collect.poll_stream(spark, str(folder))), data, "syn", check).awaitTermination()

    stopped = {"source": "syn", "feed": "station_status", "fetched_at": at(400).isoformat(), "mark": "stopped"}
    untimed = {"source": "syn", "feed": "station_status", "ok": True}
    feed(0, *polls((0, 0), (120, None)), untimed)
    (row,) = state(spark, check, "outage")
    assert (row.key.feed, row.value.mode, row.value.attempts) == ("station_status", "failing", 1)
    feed(1, *polls((240, None)))  # another query, the same state
    assert state(spark, check, "outage")[0].value.attempts == 2
    feed(2, stopped)
    assert state(spark, check, "outage") == [] and len(state(spark, check, "snapshot")) == 1
    rows = Catalog(spark, data, "syn").gaps.collect()
    assert [(r.gap_start, r.gap_end, r.reason, r.attempts) for r in rows] == [(at(0), at(400), "fetch_error", 2)]
    for number, day in ((3, 31), (4, 32), (5, 33)):
        feed(number, *polls((day * 86_400, day * 86_400), feed="vehicle_types"))
    assert {r.key.feed for r in state(spark, check, "snapshot")} == {"vehicle_types"}
    assert {r.key.feed for r in state(spark, check, "alarms")} == {"vehicle_types"}


def test_a_stream_without_checkpoint_begins_with_what_is_stored(spark, tmp_path):
    folder, data = tmp_path / "polls", str(tmp_path / "data")
    folder.mkdir()
    stored = spark.createDataFrame([("syn", "station_status", gaps._micros(at(0)), None), ("syn", "free_bike_status", gaps._micros(at(900)), gaps._micros(at(950)))], "source string, feed string, newest long, covered long")
    mark = lambda feed: {"source": "syn", "feed": feed, "fetched_at": at(1000).isoformat(), "mark": "started"}
    parts = [[mark("station_status")], polls((1010, 1005)), polls((9000, 8999)), polls((9100, 9099))]
    for k, part in enumerate(parts):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        stream = gaps.gap_stream(collect.poll_stream(spark, str(folder)), stored=stored)
        collect.store_gaps(stream, data, "syn", str(tmp_path / "check")).awaitTermination()
    rows = {(r.feed, r.gap_start, r.reason) for r in Catalog(spark, data, "syn").gaps.collect()}
    assert {("station_status", at(0), "collector_down"), ("free_bike_status", at(950), "stale_feed")} <= rows
    none = gaps.stored_state(spark, data, "syn", ["station_status"]).first()
    assert none.newest is None and none.covered == gaps._micros(max(r.gap_end for r in Catalog(spark, data, "syn").gaps.where("feed = 'station_status'").collect()))


def test_a_poller_runs_from_start_to_stop(spark, tmp_path):
    station = {"station_id": "7", "num_bikes_available": 2, "is_installed": True, "is_renting": True, "is_returning": True, "last_reported": 1_772_366_400}
    now, broken = [0], set()
    feeds = ("station_status", "vehicle_types")

    def get(url):
        if url in broken:
            raise poller.Unreachable("500", 300)
        if url == "root":
            return json.dumps({"data": {"en": {"feeds": [{"name": f, "url": f} for f in feeds]}}})
        data = {"stations": [station]} if url == "station_status" else {"vehicle_types": [{"vehicle_type_id": "a"}]}
        stamp = int(at(now[0]).replace(tzinfo=timezone.utc).timestamp())
        return json.dumps({"last_updated": stamp, "ttl": 0, "data": data})

    data, check = str(tmp_path / "data"), str(tmp_path / "check")
    places = [str(tmp_path / x) for x in ("payloads", "events")]

    def store():
        collect.collect(collect.payload_stream(spark, places[0]), data, "syn", f"{check}/a").awaitTermination()
        collect.store_gaps(gaps.gap_stream(collect.poll_stream(spark, places[1])), data, "syn", f"{check}/b").awaitTermination()

    make = lambda: poller.Poller(Provider("syn", "root", feeds), *places, get=get, clock=lambda: at(now[0]).replace(tzinfo=timezone.utc), draw=lambda: 0.0)
    one = make()
    one.start(spark, data)
    assert one.round() == 120 and one.round() == 120
    broken.add("station_status")
    now[0] = 120
    assert one.round() == 360  # 300 asked for, on the grid
    broken.clear()
    now[0] = 480
    one.round()
    store()
    catalog = Catalog(spark, data, "syn")
    assert catalog.station_status.count() == 2 and catalog.vehicle_types.count() == 1
    assert [(r.gap_start, r.gap_end, r.reason) for r in catalog.gaps.collect()] == [(at(0), at(480), "fetch_error")]

    now[0] = 4000  # another process: the daily feed has the day's snapshot, the live one was missed
    two = make()
    two.start(spark, data)
    two.round()
    assert two.seen["vehicle_types"].fetched is None and two.seen["station_status"].fetched is not None
    broken.add("station_status")
    now[0] = 4120
    two.round()
    now[0] = 4200
    two.stop()
    store()
    rows = {(r.gap_start, r.gap_end, r.reason) for r in Catalog(spark, data, "syn").gaps.where("feed = 'station_status'").collect()}
    assert rows == {(at(0), at(480), "fetch_error"), (at(480), at(4000), "collector_down"), (at(4000), at(4200), "fetch_error")}


def test_supervision_restarts_one_and_leaves_the_other():
    class Query:
        def __init__(self, lives):
            self.lives = lives

        @property
        def isActive(self):
            self.lives -= 1
            return self.lives > 0

        def exception(self):
            return "failed"

        def stop(self):
            self.lives = 0

    stop, rounds = Event(), [0]

    class Watch(Event):
        def wait(self, timeout=None):
            rounds[0] += 1
            if rounds[0] > 20:
                self.set()

    def never():
        raise RuntimeError

    count = poller.supervise({"weak": lambda: Query(3), "sound": lambda: Query(1000), "broken": never}, Watch(), rest=2, look=1)
    assert count["sound"] == 1 and count["weak"] > 1 and count["broken"] == 0 and not stop.is_set()


def test_no_bike_id_reaches_a_file_and_bad_envelopes_are_failures(spark, tmp_path):
    bike = lambda i, **more: {"bike_id": i, "lat": 52.5, "lon": 13.4, "vehicle_type_id": "e", **more}
    bikes = [bike("secret-1"), bike("secret-1", station_id="7"), bike(None), bike(None), bike("secret-2", station_id="7"), bike("secret-3", station_id="", is_disabled=True)]
    bodies = [{"last_updated": 1_772_409_000, "ttl": 60}, [1], {"last_updated": 1_772_409_000, "data": {"bikes": []}}, {"last_updated": 1_772_409_000, "ttl": 60, "data": {"bikes": bikes}}]
    asked = []

    def get(url):
        asked.append(url)
        return json.dumps({"data": {"de": {"feeds": [{"name": "free_bike_status", "url": f"u{len(asked)}"}]}}}) if url == "root" else json.dumps(bodies.pop(0))

    places = [str(tmp_path / x) for x in ("payloads", "events")]
    own = poller.Poller(Provider("syn", "root", ("free_bike_status",)), *places, get=get, clock=lambda: at(0).replace(tzinfo=timezone.utc), spark=spark)
    for failures in (1, 2, 3, 0):
        own.poll("free_bike_status")
        assert own.seen["free_bike_status"].failures == failures
    assert asked == ["root", "u1", "root", "u3", "root", "u5", "root", "u7"]  # addresses are read again after a failure
    assert [json.loads(x)["ok"] for f in sorted((tmp_path / "events").glob("*.json"), key=lambda f: f.stat().st_mtime_ns) for x in f.read_text().splitlines()] == [False, False, False, True]
    data, check = str(tmp_path / "data"), str(tmp_path / "check")
    collect.collect(collect.payload_stream(spark, places[0]), data, "syn", check).awaitTermination()
    (cell,) = {r.cell for r in Catalog(spark, data, "syn").free_bike_cells.collect()}
    rows = {(r.at_station, r.num_bikes, r.num_disabled) for r in Catalog(spark, data, "syn").free_bike_cells.collect()}
    assert rows == {(False, 4, 1), (True, 1, 0)} and cell
    written = [f for f in tmp_path.rglob("*") if f.is_file()]
    assert len(written) > 5 and not any(b"secret" in f.read_bytes() for f in written if f.suffix != ".parquet")
    assert not any("bike_id" in spark.read.parquet(str(f)).columns for f in written if f.suffix == ".parquet")


def test_providers_from_the_environment():
    found = providers({"PEDALFLOW_PROVIDERS": json.dumps({"one": "http://a", "two": {"url": "http://b", "feeds": ["station_status"]}, "off": {"url": "x", "enabled": False}})})
    assert list(found) == ["one", "two"] and found["two"].feeds == ("station_status",) and len(found["one"].feeds) == 4
    assert providers({}) == {}
    for bad in ('{"a/b": "x"}', '{"a": {"url": "x", "feeds": ["other"]}}'):
        with pytest.raises(ValueError):
            providers({"PEDALFLOW_PROVIDERS": bad})


def test_weather_is_filled_until_nothing_is_missing(spark, tmp_path):
    asked, waits = [], []

    def get(url):
        asked.append(url)
        if len(asked) == 2:
            raise poller.Unreachable("503")
        day = url[-10:]
        return json.dumps({"weather": [{"timestamp": f"{day}T{h:02d}:00:00+00:00", "precipitation": 0.0, "temperature": 5.0, "condition": "dry"} for h in range(24)]})

    assert main.fill_weather(spark, str(tmp_path), "2026-03-05", 4, "x/{date}", get, sleep=waits.append) == 0
    assert len(asked) == 4 and waits == [120] and Catalog(spark, str(tmp_path)).weather.count() == 72
    assert main.fill_weather(spark, str(tmp_path), "2026-03-05", 4, "x/{date}", get) == 0 and len(asked) == 4


def test_collecting_stores_once_and_leaves_other_sources(spark, tmp_path):
    folder, data = tmp_path / "in", str(tmp_path / "data")
    folder.mkdir()
    station = {"station_id": "7", "num_bikes_available": 2, "is_installed": True, "is_renting": True, "is_returning": True, "last_reported": 1_772_408_000}
    body = json.dumps({"last_updated": 1_772_409_000, "ttl": 60, "data": {"stations": [station]}})
    line = lambda source: json.dumps({"source": source, "feed": "station_status", "fetched_at": at(0).isoformat(), "json": body})
    for k, text in enumerate((line("syn"), line("syn") + "\n" + line("other"))):
        (folder / f"{k}.json").write_text(text)
        collect.collect(collect.payload_stream(spark, str(folder)), data, "syn", str(tmp_path / "check")).awaitTermination()
    assert Catalog(spark, data, "syn").station_status.count() == 1 and Catalog(spark, data, "other").station_status.count() == 0


@pytest.mark.parametrize("build,rows", [(collect.hourly_availability, 1), (collect.empty_episodes, 1)])
def test_windows_over_a_stream(spark, tmp_path, build, rows):
    folder = tmp_path / "s"
    folder.mkdir()
    line = lambda m, n: json.dumps({"source": "syn", "station_id": "1", "snapshot_ts": (T0 + timedelta(minutes=m)).isoformat(), "num_bikes_available": n, "is_installed": True})
    (folder / "0.json").write_text("\n".join(line(m, n) for m, n in ((0, 0), (5, 0), (5, 0), (30, 4), (400, 0))))
    (folder / "1.json").write_text(line(401, 0))
    status = spark.readStream.schema("source string, station_id string, snapshot_ts timestamp, num_bikes_available int, is_installed boolean").option("maxFilesPerTrigger", 1).json(str(folder))
    query = build(status).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").count() == rows


def test_nonlinear_weather_model_recovers_its_parameters():
    rng = np.random.default_rng(0)
    x = np.column_stack((rng.integers(0, 2, 400), np.linspace(0, 1, 400), rng.uniform(10, 95, 400), rng.uniform(0, 1, 400), rng.uniform(0, 5, 400)))
    true = np.array([8.0, 0.3, 0.5, 9000.0, -20.0, -3.0, 55.0, 12.0])
    fit = models.levenberg_marquardt(models.weather_model, x, models.weather_model(x, true), np.array([7.5, 0.1, 0.1, 6000.0, -10.0, -1.0, 50.0, 15.0]))
    assert np.allclose(models.weather_model(x, fit), models.weather_model(x, true), rtol=1e-3)


def test_ols_with_dependent_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 + 3 * i - (i % 3)) for i in range(30)], "a double, b double, y double")
    fit = models.ols(df, "y", {"a": F.col("a"), "b": F.col("b")})
    assert fit == pytest.approx({"intercept": 2.0, "a": 3.0, "b": -1.0})
    done = models.predict(df, "y", {"a": F.col("a"), "b": F.col("b")}, fit)
    assert models.rmse(done).first().rmse == pytest.approx(0, abs=1e-8)
