"""The polling half of collection: fetches due feeds and drops payloads and events as files for the streams.

One poller serves one provider. It keeps nothing that the files and storage don't hold: a new one starts from what is
stored, and writes the events from which the gap stream learns of starts, failures and stops.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from threading import Event
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.registry import Provider
from ..sources.storage import latest_snapshot
from . import gaps, schedule

LANGUAGE = "de"
TIMEOUT = 30


class Unreachable(Exception):
    """A fetch that gave no payload; ``asked`` are the seconds that the server wants to be left alone."""

    def __init__(self, why: str, asked: float | None = None):
        super().__init__(why)
        self.asked = asked


def fetch(url: str, agent: str = "pedalflow") -> str:
    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=TIMEOUT) as answer:
            return answer.read().decode()
    except HTTPError as error:
        raise Unreachable(str(error.code), schedule.retry_after(error.headers.get("Retry-After"), datetime.now(timezone.utc))) from error
    except (OSError, UnicodeDecodeError) as error:
        raise Unreachable(type(error).__name__) from error


def drop_lines(spark: SparkSession, folder: str, rows: list[dict]) -> None:
    """Rows as one file of JSON lines that appears at once, on whichever file system the folder is; streams skip names
    that begin with a dot."""
    if not rows:
        return
    text = "".join(json.dumps(r, default=lambda t: t.isoformat()) + "\n" for r in rows)
    path, name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, f"{uuid.uuid4().hex}.json"
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(folder))
    hidden = path(f"{folder}/.{name}")
    out = store.create(hidden)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not store.rename(hidden, path(f"{folder}/{name}")):
        raise OSError(f"{folder}/{name}")


def checked(body: str) -> dict:
    """A payload with its envelope: an object that has last_updated, ttl and data."""
    told = json.loads(body)
    if not isinstance(told, dict):
        raise ValueError("no object")
    for key in ("last_updated", "ttl", "data"):
        told[key]
    return told


#: What is kept of a free-floating bike.
BIKE = ("lat", "lon", "vehicle_type_id", "station_id", "is_disabled", "is_reserved")


def without_ids(told: dict) -> dict:
    """A free_bike_status payload with each bike once and no bike's id, before anything of it is written."""
    first: dict[object, dict] = {}
    for k, bike in enumerate(told["data"]["bikes"]):
        ident = bike.get("bike_id")
        first.setdefault((True, ident) if ident is not None else (False, k), {c: bike[c] for c in BIKE if c in bike})
    return {k: told[k] for k in ("last_updated", "ttl")} | {"data": {"bikes": list(first.values())}}


@dataclass
class Seen:
    """Of a feed: when it was asked for last, what it said, and its failures in a row."""

    fetched: datetime | None = None
    updated: datetime | None = None
    ttl: int = 0
    failures: int = 0
    retry: datetime | None = None
    stored: datetime | None = None


@dataclass
class Poller:
    provider: Provider
    payloads: str
    events: str
    get: Callable[[str], str] = fetch
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    draw: Callable[[], float] = random.random
    seen: dict[str, Seen] = field(default_factory=dict)
    urls: dict[str, str] | None = None
    spark: SparkSession | None = None

    def drop(self, folder: str, rows: list[dict]) -> None:
        drop_lines(self.spark or SparkSession.builder.getOrCreate(), folder, rows)

    def start(self, spark: SparkSession, data_dir: str) -> None:
        """Takes up what storage holds."""
        self.spark, now, name = spark, self.clock(), self.provider.name
        for feed in self.provider.feeds:
            stored = latest_snapshot(spark, data_dir, name, gaps.DATASETS[feed])
            self.seen[feed] = Seen(stored=None if stored is None else stored.astimezone(timezone.utc))
        self.drop(self.events, gaps.starts(spark, data_dir, name, list(self.provider.feeds), now))

    def due(self, feed: str) -> datetime:
        s = self.seen.setdefault(feed, Seen())
        return schedule.due(schedule.INTERVALS[feed], self.clock(), s.fetched, s.updated, s.ttl, s.retry, s.stored)

    def address(self, feed: str) -> str:
        if self.urls is None:
            data = json.loads(self.get(self.provider.discovery))["data"]
            listed = data.get(LANGUAGE) or data[min(data)]
            self.urls = {f["name"]: f["url"] for f in listed["feeds"]}
        return self.urls[feed]

    def poll(self, feed: str) -> None:
        """Asks for one feed. A snapshot that came before is no payload again."""
        now, s = self.clock(), self.seen.setdefault(feed, Seen())
        event = {"source": self.provider.name, "feed": feed, "fetched_at": now, "ok": False}
        try:
            body = self.get(self.address(feed))
            told = checked(body)
            updated = datetime.fromtimestamp(told["last_updated"], timezone.utc)
            ttl = int(told["ttl"] or 0)
            body = json.dumps(without_ids(told)) if feed == "free_bike_status" else body
        except (Unreachable, ValueError, KeyError, TypeError, AttributeError) as error:
            # The next try asks for the feeds' addresses anew.
            s.failures, self.urls = s.failures + 1, None
            wait = schedule.pause(s.failures, self.draw(), getattr(error, "asked", None), schedule.INTERVALS[feed])
            s.retry = now + timedelta(seconds=wait)
        else:
            if updated != (s.updated or s.stored):
                self.drop(self.payloads, [{"source": self.provider.name, "feed": feed, "fetched_at": now, "json": body}])
            s.fetched, s.updated, s.ttl, s.failures, s.retry = now, updated, ttl, 0, None
            event |= {"ok": True, "last_updated": updated}
        self.drop(self.events, [event])

    def round(self) -> float:
        """Polls what is due; the seconds until something is again."""
        for feed in self.provider.feeds:
            if self.due(feed) <= self.clock():
                self.poll(feed)
        return max(0.0, (min(map(self.due, self.provider.feeds)) - self.clock()).total_seconds())

    def stop(self) -> None:
        self.drop(self.events, gaps.stops(self.provider.name, list(self.provider.feeds), self.clock()))

    def run(self, spark: SparkSession, data_dir: str, stop: Event) -> None:
        self.start(spark, data_dir)
        try:
            while not stop.is_set():
                stop.wait(max(1.0, self.round()))
        finally:
            self.stop()


def supervise(queries: dict[str, Callable[[], StreamingQuery]], stop: Event, rest: float = 120, look: float = 1) -> dict[str, int]:
    """Keeps a stream running under each name until ``stop``; one that fails starts anew after ``rest`` seconds, and the
    others go on meanwhile. Returns how often each was started."""
    running: dict[str, StreamingQuery] = {}
    asleep: dict[str, float] = {}
    count = dict.fromkeys(queries, 0)
    while not stop.is_set():
        for name, start in queries.items():
            if name in running and running[name].isActive:
                continue
            if name in running and running.pop(name).exception() is not None:
                asleep[name] = rest
            if asleep.get(name, 0) > 0:
                asleep[name] -= look
                continue
            try:
                running[name] = start()
                count[name] += 1
            except Exception:  # one provider's trouble is not the others'
                asleep[name] = rest
        stop.wait(look)
    for query in running.values():
        query.stop()
    return count
