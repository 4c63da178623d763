"""Gaps of feeds as a stateful stream: what happens to a feed goes in, gap rows come out.

A feed is in one of three modes, and each kind of event moves it by the table MOVES. Polls are events of the kinds
``failed``, ``newer`` and ``same``; ``started`` and ``stopped`` frame a run of the collector; ``quiet`` comes from a
timer when the watermark, which the other feeds push on, passes the time at which this one's snapshot is too old.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..sources.storage import latest_gap_end, latest_snapshot
from .schedule import DAY, INTERVALS, SHORTEST

#: A feed is stale after so many intervals without a newer snapshot; the collector was down if it starts so many late.
STALE_AFTER, DOWN_AFTER = 3, 2

#: State of a feed that has no outage is cleared so long after its last event.
FORGET_AFTER = timedelta(days=30)

EPOCH = datetime(1970, 1, 1)

#: ``mark`` is null for polls, else 'started' or 'stopped'; a start brings the stored snapshot as last_updated and the
#: end of the last stored gap as covered.
POLLS = "source string, feed string, fetched_at timestamp, ok boolean, last_updated timestamp, mark string, covered timestamp"
GAPS = "source string, feed string, gap_start timestamp, gap_end timestamp, reason string, attempts int"

#: What the stream serves: the dataset that holds each feed's snapshots.
DATASETS = {feed: "free_bike_cells" if feed == "free_bike_status" else feed for feed in INTERVALS}


class Feed(NamedTuple):
    """What is known of a feed. ``since`` and ``attempts`` are those of the outage it is in; ``told`` is the snapshot
    whose staleness has a row; ``covered`` is where the last gap ended."""

    mode: str = "clear"
    newest: datetime | None = None
    since: datetime | None = None
    attempts: int = 0
    told: datetime | None = None
    covered: datetime | None = None


Gap = tuple[datetime, datetime, str, int]
Step = tuple[Feed, list[Gap]]


def _later(*times: datetime | None) -> datetime | None:
    return max((t for t in times if t is not None), default=None)


def _record(feed: Feed, start: datetime, end: datetime, reason: str, attempts: int) -> Step:
    """A row for a stretch that has a length."""
    return (feed._replace(covered=_later(feed.covered, end)), [(start, end, reason, attempts)]) if end > start else (feed, [])


def _ended(feed: Feed, end: datetime) -> Step:
    reason = {"failing": "fetch_error", "down": "collector_down"}[feed.mode]
    return _record(feed._replace(mode="clear", since=None, attempts=0), feed.since, end, reason, feed.attempts)


def _stay(feed: Feed, now: datetime, interval: int) -> Step:
    return feed, []


def _start(feed: Feed, now: datetime, interval: int) -> Step:
    """Too long after the newest snapshot: nobody was looking. What a gap covers already isn't counted again. Feeds of
    one snapshot a day have no such outage."""
    late = feed.newest is not None and now - feed.newest > timedelta(seconds=DOWN_AFTER * interval)
    return (feed._replace(mode="down", since=_later(feed.newest, feed.covered)) if late and interval < DAY else feed), []


def _fail(feed: Feed, now: datetime, interval: int) -> Step:
    """An outage begins with the newest snapshot, or now if there is none or its staleness has the row of that start."""
    known = feed.newest is not None and feed.newest != feed.told
    return feed._replace(mode="failing", since=feed.newest if known else now, attempts=1), []


def _again(feed: Feed, now: datetime, interval: int) -> Step:
    return feed._replace(attempts=feed.attempts + 1), []


def _watch(feed: Feed, now: datetime, interval: int) -> Step:
    """One row for a snapshot that got too old."""
    if feed.newest in (None, feed.told) or now - feed.newest <= timedelta(seconds=STALE_AFTER * interval):
        return feed, []
    return _record(feed._replace(told=feed.newest), _later(feed.newest, feed.covered), now, "stale_feed", 0)


def _recover(feed: Feed, now: datetime, interval: int) -> Step:
    """The outage ends with the newest snapshot; whether that one is too old is another question."""
    feed, gaps = _ended(feed, feed.newest or feed.since)
    feed, more = _watch(feed, now, interval)
    return feed, gaps + more


def _return(feed: Feed, now: datetime, interval: int) -> Step:
    """Back after a down time, if the snapshot is one from after it."""
    return _recover(feed, now, interval) if feed.newest > feed.since else (feed, [])


def _close(feed: Feed, now: datetime, interval: int) -> Step:
    return _ended(feed, now)


MOVES: dict[tuple[str, str], Callable[[Feed, datetime, int], Step]] = {
    ("clear", "started"): _start,
    ("clear", "failed"): _fail,
    ("clear", "newer"): _watch,
    ("clear", "same"): _watch,
    ("clear", "quiet"): _watch,
    ("clear", "stopped"): _stay,
    ("failing", "started"): _stay,
    ("failing", "failed"): _again,
    ("failing", "newer"): _recover,
    ("failing", "same"): _recover,
    ("failing", "quiet"): _stay,
    ("failing", "stopped"): _close,
    ("down", "started"): _stay,
    ("down", "failed"): _again,
    ("down", "newer"): _return,
    ("down", "same"): _stay,
    ("down", "quiet"): _stay,
    ("down", "stopped"): _close,
}


def move(feed: Feed, kind: str, now: datetime, interval: int) -> Step:
    return MOVES[feed.mode, kind](feed, now, interval)


def _plain(value):
    return None if value is None or pd.isna(value) else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


class Event(NamedTuple):
    """What happened to a feed; columns as in POLLS, times without a zone, in UTC."""

    fetched_at: datetime
    ok: bool | None
    last_updated: datetime | None = None
    mark: str | None = None
    covered: datetime | None = None


def play(feed: Feed, events: Iterable[Event], interval: int) -> Step:
    """Events, in order of time, through the table."""
    rows: list[Gap] = []
    for event in sorted(events, key=lambda e: e.fetched_at):
        fresh = event.last_updated is not None and (feed.newest is None or event.last_updated > feed.newest)
        kind = event.mark or ("failed" if not event.ok else "newer" if fresh else "same")
        if kind in ("newer", "started"):
            feed = feed._replace(newest=_later(feed.newest, event.last_updated), covered=_later(feed.covered, event.covered))
        feed, found = move(feed, kind, event.fetched_at, interval)
        rows += found
    return feed, rows


def replay(feed: Feed, events: pd.DataFrame, interval: int) -> Step:
    """The same from a frame with the columns of Event."""
    return play(feed, [Event(*map(_plain, e)) for e in events[list(Event._fields)].itertuples(index=False)], interval)


def _instant(micros: int | None) -> datetime | None:
    return None if micros is None else EPOCH + timedelta(microseconds=micros)


def _micros(time: datetime | None) -> int | None:
    return None if time is None else (time - EPOCH) // timedelta(microseconds=1)


class FeedGaps(StatefulProcessor):
    """A feed's part of the stream, in state variables of their own; times are microseconds since 1970.

    ``snapshot``: the newest one, and the one whose staleness was told. ``outage``: there only while one lasts.
    ``covered``: where the last gap ended. ``alarms``: the timers by what they are for. ``stale`` rings when the newest
    snapshot is too old, ``forget`` when a feed without an outage had no event for FORGET_AFTER, and clears all of its
    state. (Spark gives state a time to live in processing time only, so a timer does it here.)
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", "newest long, told long")
        self.outage = handle.getValueState("outage", "mode string, since long, attempts int")
        self.covered = handle.getValueState("covered", "until long")
        self.alarms = handle.getMapState("alarms", "why string", "at long")

    def _load(self) -> Feed:
        newest, told = self.snapshot.get() or (None, None)
        mode, since, attempts = self.outage.get() or ("clear", None, 0)
        (until,) = self.covered.get() or (None,)
        return Feed(mode, _instant(newest), _instant(since), attempts, _instant(told), _instant(until))

    def _save(self, feed: Feed) -> None:
        self.snapshot.update((_micros(feed.newest), _micros(feed.told)))
        if feed.mode == "clear":
            self.outage.clear()
        else:
            self.outage.update((feed.mode, _micros(feed.since), feed.attempts))
        if feed.covered is not None:
            self.covered.update((_micros(feed.covered),))

    def _set(self, why: str, time: datetime | None, watermark: int) -> None:
        """At most one alarm of each purpose; purposes that share an instant share its timer."""
        wanted = None if time is None else max(-(-_micros(time) // 1000), watermark + 1)
        known = self.alarms.getValue((why,))[0] if self.alarms.containsKey((why,)) else None
        if wanted == known:
            return
        if known is not None:
            self.alarms.removeKey((why,))
            if all(at != known for _, (at,) in list(self.alarms.iterator())):
                self.handle.deleteTimer(known)
        if wanted is not None:
            self.alarms.updateValue((why,), (wanted,))
            self.handle.registerTimer(wanted)

    def _watch_over(self, key: tuple, feed: Feed, watermark: int) -> None:
        waits = feed.mode == "clear" and feed.newest not in (None, feed.told)
        interval = INTERVALS.get(key[1], SHORTEST)
        self._set("stale", feed.newest + timedelta(seconds=STALE_AFTER * interval, milliseconds=1) if waits else None, watermark)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        feed = Feed(newest=_instant(initialState.newest), covered=_instant(initialState.covered))
        self._save(feed)
        self._watch_over(key, feed, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = [Event(_instant(r.fetched), r.ok, _instant(r.updated), r.mark, _instant(r.known)) for r in rows]
        feed, gaps = play(self._load(), events, INTERVALS.get(key[1], SHORTEST))
        self._save(feed)
        watermark = timerValues.getCurrentWatermarkInMs()
        self._watch_over(key, feed, watermark)
        # Whole days, so that the timer moves once a day.
        last = max(e.fetched_at for e in events) + FORGET_AFTER
        self._set("forget", EPOCH + timedelta(days=(last - EPOCH).days + 1) if feed.mode == "clear" else None, watermark)
        yield from self._rows(key, gaps)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        due = {why for (why,), (at,) in list(self.alarms.iterator()) if at <= expiredTimerInfo.getExpiryTimeInMs()}
        for why in due:
            self.alarms.removeKey((why,))
        watermark = timerValues.getCurrentWatermarkInMs()
        if "stale" in due:
            feed, gaps = move(self._load(), "quiet", _instant(watermark * 1000), INTERVALS.get(key[1], SHORTEST))
            self._save(feed)
            self._watch_over(key, feed, watermark)
            yield from self._rows(key, gaps)
        if "forget" in due:
            self._set("stale", None, watermark)
            for state in (self.snapshot, self.outage, self.covered, self.alarms):
                state.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key: tuple, gaps: list[Gap]) -> Iterator[Row]:
        for start, end, reason, attempts in gaps:
            yield Row(source=key[0], feed=key[1], start=_micros(start), end=_micros(end), reason=reason, attempts=attempts)


def gap_stream(polls: DataFrame, late: str = "1 minute", stored: DataFrame | None = None) -> DataFrame:
    """Gap rows of a stream of events (columns as in POLLS), one state a source and feed. Append output.

    A feed that is not polled any more is called stale once the other feeds' polls have moved the watermark on.
    ``stored`` (as from stored_state) is what a stream without a checkpoint begins with. Events without a time are left
    out. The session's state store must be RocksDB's, as in ``session.SETTINGS``.
    """
    micros = {"fetched": F.unix_micros("fetched_at"), "updated": F.unix_micros("last_updated"), "known": F.unix_micros("covered")}
    events = polls.where("fetched_at is not null").withWatermark("fetched_at", late).withColumns(micros).select("source", "feed", "fetched_at", "ok", "mark", *micros)
    begin = stored.groupBy("source", "feed") if stored is not None else None
    found = events.groupBy("source", "feed").transformWithState(FeedGaps(), "source string, feed string, start long, end long, reason string, attempts int", "append", "EventTime", begin)
    return found.select("source", "feed", F.timestamp_micros("start").alias("gap_start"), F.timestamp_micros("end").alias("gap_end"), "reason", "attempts")


def gaps_of(polls: DataFrame) -> DataFrame:
    """The same over a finished table of events, without timers.

    A feed's events pass one task in order, as its state demands, but batch by batch: no task holds them all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, feed = None, Feed()
        for frame in frames:
            rows = []
            for (source, name), part in frame.groupby(["source", "feed"], sort=False, dropna=False):
                own = (_plain(source), _plain(name))
                if own != key:
                    key, feed = own, Feed()
                feed, found = replay(feed, part, INTERVALS.get(own[1], SHORTEST))
                rows += [(*own, *r) for r in found]
            yield pd.DataFrame(rows, columns=["source", "feed", "gap_start", "gap_end", "reason", "attempts"])

    ordered = polls.where("fetched_at is not null").select("source", "feed", *Event._fields).repartition("source", "feed").sortWithinPartitions("source", "feed", "fetched_at")
    return ordered.mapInPandas(run, GAPS)


def _zoned(found: datetime | None) -> datetime | None:
    """What the driver's rows hold is in its own local time."""
    return None if found is None else found.astimezone(timezone.utc)


def starts(spark: SparkSession, data_dir: str, source: str, feeds: list[str], now: datetime) -> list[dict]:
    """The events of a collector's start: what storage holds of each feed. For a stream whose state is older or lost."""
    return [
        {
            "source": source,
            "feed": feed,
            "fetched_at": now,
            "ok": None,
            "last_updated": _zoned(latest_snapshot(spark, data_dir, source, DATASETS.get(feed, feed))),
            "mark": "started",
            "covered": _zoned(latest_gap_end(spark, data_dir, source, feed)),
        }
        for feed in feeds
    ]


def stored_state(spark: SparkSession, data_dir: str, source: str, feeds: list[str]) -> DataFrame:
    """What storage holds of each feed (one row a feed), as the initial state of a stream that has no checkpoint."""
    rows = starts(spark, data_dir, source, feeds, datetime.now(timezone.utc))
    plain = lambda t: None if t is None else t.replace(tzinfo=None)
    return spark.createDataFrame([(source, r["feed"], _micros(plain(r["last_updated"])), _micros(plain(r["covered"]))) for r in rows], "source string, feed string, newest long, covered long")


def stops(source: str, feeds: list[str], now: datetime) -> list[dict]:
    """The events of a collector's end, which close open outages."""
    return [{"source": source, "feed": feed, "fetched_at": now, "ok": None, "last_updated": None, "mark": "stopped", "covered": None} for feed in feeds]


def collector_down(rows: DataFrame, now: datetime, covered: DataFrame | None = None) -> DataFrame:
    """The rule of a late start over stored keys (source, feed, snapshot_ts), as columns: feeds whose newest snapshot is
    too old at ``now``, with the start of their outage."""
    newest = rows.groupBy("source", "feed").agg(F.max("snapshot_ts").alias("last"))
    interval = F.coalesce(*[F.when(F.col("feed") == f, F.lit(s)) for f, s in INTERVALS.items()], F.lit(SHORTEST))
    old = newest.where((interval < DAY) & (F.unix_seconds(F.lit(now)) - F.unix_seconds("last") > DOWN_AFTER * interval))
    if covered is None:
        return old.select("source", "feed", F.col("last").alias("gap_start"))
    return old.join(covered, ["source", "feed"], "left").select("source", "feed", F.greatest("last", "gap_end").alias("gap_start"))
