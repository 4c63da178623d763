"""Command line: poll, collect, gaps, supervise, areas, compact, metric, export, weather-missing, weather, nightly."""

from __future__ import annotations

import argparse
import os
import signal
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import partial
from threading import Event
from time import sleep

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.spatial import map_stations
from .plans import metrics
from .session import session
from .sources import feeds, storage
from .sources.catalog import Catalog
from .sources.registry import providers
from .streaming.poller import Poller, fetch, supervise
from .streaming.schedule import next_nightly, pause


@dataclass(frozen=True)
class Settings:
    """From the environment alone."""

    data_dir: str
    source: str

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        if not env.get("PEDALFLOW_DATA_DIR"):
            raise ValueError("PEDALFLOW_DATA_DIR is not set")
        return cls(env["PEDALFLOW_DATA_DIR"], env.get("PEDALFLOW_SOURCE", "bikes"))


METRICS = {
    "availability": lambda c, a: metrics.availability_by_hour(c, a.by),
    "empty-stations": lambda c, _: metrics.empty_minutes_by_station(c),
    "empty-ortsteile": lambda c, _: metrics.empty_minutes_by_ortsteil(c),
    "net-flow": lambda c, _: metrics.net_flow_by_bezirk(c),
    "flow-between": lambda c, _: metrics.flow_between_bezirke(c),
    "footprint": lambda c, _: metrics.daily_footprint(c),
    "station-profiles": lambda c, _: metrics.station_profiles(c),
    "ortsteil-profiles": lambda c, _: metrics.ortsteil_profiles(c),
    "weather": lambda c, a: metrics.weather_effect(c, a.kind),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pedalflow", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    collect = sub.add_parser("collect")
    collect.add_argument("--payloads", required=True)
    collect.add_argument("--checkpoint", required=True)
    collect.add_argument("--every")
    gaps = sub.add_parser("gaps")
    gaps.add_argument("--polls", required=True)
    gaps.add_argument("--checkpoint", required=True)
    areas = sub.add_parser("areas")
    areas.add_argument("--bezirke", required=True)
    areas.add_argument("--ortsteile", required=True)
    areas.add_argument("--name", default="name")
    compact = sub.add_parser("compact")
    compact.add_argument("dataset")
    compact.add_argument("--out", required=True)
    metric = sub.add_parser("metric")
    metric.add_argument("name", choices=sorted(METRICS))
    metric.add_argument("--by", default="city")
    metric.add_argument("--kind", default="rain")
    metric.add_argument("--out", required=True)
    poll = sub.add_parser("poll")
    poll.add_argument("--provider", required=True)
    poll.add_argument("--payloads", required=True)
    poll.add_argument("--events", required=True)
    several = sub.add_parser("supervise")
    several.add_argument("--payloads", required=True)
    several.add_argument("--polls", required=True)
    several.add_argument("--checkpoint", required=True)
    several.add_argument("--every", default="120 seconds")
    export = sub.add_parser("export")
    export.add_argument("--out", required=True)
    for name in ("weather-missing", "weather", "nightly"):
        days = sub.add_parser(name)
        days.add_argument("--today", default=date.today().isoformat())
        days.add_argument("--days-back", type=int, default=7)
        if name != "weather-missing":
            days.add_argument("--url", required=True, help="address of a day's weather, with {date} in it")
        if name == "nightly":
            days.add_argument("--out", required=True)
            days.add_argument("--wait", action="store_true", help="every night at 03:30 local time instead of once, now")
    return top


def fill_weather(spark: SparkSession, data_dir: str, today: str, days_back: int, url: str, get: Callable[[str], str] = fetch, rounds: int = 5, sleep: Callable[[float], None] = sleep) -> int:
    """Fetches days that storage lacks, again after a pause where some failed; how many are still missing."""
    for n in range(1, rounds + 1):
        for (day,) in storage.missing_days(spark, data_dir, today, days_back).collect():
            try:
                payload = spark.createDataFrame([(get(url.format(date=day.isoformat())),)], "json string")
                storage.write_days_once(feeds.weather_day(feeds.weather_hours(payload), day.isoformat()), data_dir)
            except Exception as error:  # a day that can't be had leaves the others
                print(f"weather of {day}: {type(error).__name__}")
        left = storage.missing_days(spark, data_dir, today, days_back).count()
        if not left or n == rounds:
            return left
        sleep(pause(n, 1.0))
    return 0


def export(catalog: Catalog, out: str) -> dict[str, str]:
    """Every metric's rows as JSON under its name; the status of each, as there are no rows below the minimum of days."""
    status = {}
    for name, metric in METRICS.items():
        result = metric(catalog, argparse.Namespace(by="city", kind="rain"))
        status[name] = result.status
        if result.rows is not None:
            storage.write_nested_json(result.rows, f"{out}/{name}", files=1)  # a few thousand rows at most
    return status


def nightly(catalog: Catalog, args: argparse.Namespace, today: str) -> int:
    left = fill_weather(catalog.spark, catalog.data_dir, today, args.days_back, args.url)
    print(export(catalog, args.out))
    return 1 if left else 0


def stopping() -> Event:
    """Set by the signals that end a process."""
    stop = Event()
    for number in (signal.SIGTERM, signal.SIGINT):
        signal.signal(number, lambda *_: stop.set())
    return stop


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = Settings.from_env()
    spark = session()
    catalog = Catalog(spark, settings.data_dir, settings.source)
    if args.command == "collect":
        from .streaming import collect

        collect.collect(collect.payload_stream(spark, args.payloads), settings.data_dir, settings.source, args.checkpoint, args.every).awaitTermination()
    elif args.command == "gaps":
        from .streaming import collect, gaps

        collect.store_gaps(gaps.gap_stream(collect.poll_stream(spark, args.polls), stored=gaps.stored_state(spark, settings.data_dir, settings.source, list(gaps.INTERVALS))), settings.data_dir, settings.source, args.checkpoint).awaitTermination()
    elif args.command == "areas":
        newest = metrics.newest_known(catalog.table("station_information"), metrics.STATION, ["lat", "lon"])
        good, problems = map_stations(newest, {"bezirk": feeds.read_geojson(spark, args.bezirke, args.name), "ortsteil": feeds.read_geojson(spark, args.ortsteile, args.name)})
        storage.write_station_areas(good, settings.data_dir)
        problems.show(truncate=False)
    elif args.command == "compact":
        storage.compact(spark, settings.data_dir, settings.source, args.dataset, args.out)
    elif args.command == "metric":
        result = METRICS[args.name](catalog, args)
        print(f"{result.name}: {result.status}, {result.message}")
        if result.rows is not None:
            result.rows.write.mode("overwrite").parquet(args.out)
    elif args.command == "poll":
        Poller(providers(os.environ)[args.provider], args.payloads, args.events).run(spark, settings.data_dir, stopping())
    elif args.command == "supervise":
        from .streaming import collect, gaps

        jobs = {}
        for name in providers(os.environ):
            place = f"{args.checkpoint}/{name}"
            jobs[f"{name} snapshots"] = partial(collect.collect, collect.payload_stream(spark, args.payloads), settings.data_dir, name, f"{place}/snapshots", args.every)
            jobs[f"{name} gaps"] = partial(collect.store_gaps, gaps.gap_stream(collect.poll_stream(spark, args.polls), stored=gaps.stored_state(spark, settings.data_dir, name, list(gaps.INTERVALS))), settings.data_dir, name, f"{place}/gaps", args.every)
        supervise(jobs, stopping())
    elif args.command == "export":
        print(export(catalog, args.out))
    elif args.command == "weather":
        return 1 if fill_weather(spark, settings.data_dir, args.today, args.days_back, args.url) else 0
    elif args.command == "nightly":
        if not args.wait:
            return nightly(catalog, args, args.today)
        stop = stopping()
        while not stop.is_set():
            now = datetime.now(timezone.utc)
            if not stop.wait((next_nightly(now) - now).total_seconds()):
                nightly(catalog, args, date.today().isoformat())
    else:
        storage.missing_days(spark, settings.data_dir, args.today, args.days_back).orderBy(F.col("date")).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
