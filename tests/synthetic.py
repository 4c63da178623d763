"""A scripted city whose metrics are known: snapshots every quarter of an hour of local time."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

ZONE = ZoneInfo("Europe/Berlin")
AREAS = [("EMPTY", "C", "C1"), ("BUDDY", "C", "C2"), ("FLOW-A", "A", "A1"), ("FLOW-B", "B", "B1"), ("REST", "B", "B2")]
STATUS = "source string, station_id string, snapshot_ts timestamp_ntz, num_bikes_available int, is_installed boolean, vehicle_types_available array<struct<vehicle_type_id: string, count: int>>"
GAPS = "source string, feed string, gap_start timestamp_ntz, gap_end timestamp_ntz, reason string, attempts int"


def bikes(station: str, wall: datetime) -> int:
    weekday, at = wall.weekday() <= 4, wall.hour * 60 + wall.minute
    if station in ("EMPTY", "BUDDY"):
        gone = weekday and 465 <= at < 510  # 07:45 to 08:30
        return (0 if gone else 5) if station == "EMPTY" else (10 if gone else 5)
    if station.startswith("FLOW"):
        moved = 0
        if weekday:
            moved = 3 * ((at >= 450) + (at >= 510) - (at >= 1050) - (at >= 1110))
        return 7 - moved if station == "FLOW-A" else 7 + moved
    return 4


def snapshots(first: date, days: int, step_minutes: int = 15):
    """UTC instants of some local days."""
    now = datetime(first.year, first.month, first.day, tzinfo=ZONE).astimezone(UTC)
    last = first + timedelta(days=days)
    end = datetime(last.year, last.month, last.day, tzinfo=ZONE).astimezone(UTC)
    while now < end:
        yield now
        now += timedelta(minutes=step_minutes)


def city(spark, first: date = date(2026, 10, 12), days: int = 28, gap: bool = True):
    """Tables of the city; on the third day a gap from 02:00 to 03:30 local time swallows its snapshots."""
    day = first + timedelta(days=2)
    start = datetime(day.year, day.month, day.day, 2, tzinfo=ZONE).astimezone(UTC)
    end = start + timedelta(minutes=90)
    rows = []
    for ts in snapshots(first, days):
        if gap and start <= ts < end:
            continue
        wall = ts.astimezone(ZONE)
        for s, _, _ in AREAS:
            n = bikes(s, wall)
            rows.append(("syn", s, ts.replace(tzinfo=None), n, True, [("ebike", n // 5), ("pedal", n - n // 5)]))
    gaps = [("syn", "station_status", start.replace(tzinfo=None), end.replace(tzinfo=None), "fetch_error", 3)] if gap else []
    return {
        "station_status": spark.createDataFrame(rows, STATUS),
        "gaps": spark.createDataFrame(gaps, GAPS),
        "station_areas": spark.createDataFrame([("syn", s, b, o) for s, b, o in AREAS], "source string, station_id string, bezirk string, ortsteil string"),
    }
