"""When feeds are due: intervals, times to live, pauses after failures, days that are done, the nightly job."""

from __future__ import annotations

from datetime import datetime, time, timedelta, timezone
from email.utils import parsedate_to_datetime
from zoneinfo import ZoneInfo

from ..functions.localtime import ZONE

DAY = 86_400
#: Seconds between polls of live and of daily feeds.
INTERVALS = {"station_status": 120, "free_bike_status": 120, "station_information": DAY, "vehicle_types": DAY}
#: The grid that retries keep to, and the bound of a pause: after the first failure, and at most.
SHORTEST, FIRST_PAUSE, LONGEST_PAUSE = 120, 120, 1800
NIGHTLY = time(3, 30)


def retry_after(header: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or as a date; None if it asks for nothing readable."""
    text = (header or "").strip()
    if text.isdigit():
        return float(text)
    try:
        when = parsedate_to_datetime(text)
    except ValueError:
        return None
    return max(0.0, (when.replace(tzinfo=when.tzinfo or timezone.utc) - now).total_seconds())


def pause(failures: int, draw: float, asked: float | None = None, interval: int = SHORTEST) -> int:
    """Seconds to wait after so many failures in a row: the part ``draw`` (0 to 1) of a bound that doubles each time, or
    what the server asked for if that is more, never over LONGEST_PAUSE, rounded up to the grid of polls."""
    bound = min(LONGEST_PAUSE, FIRST_PAUSE << min(failures - 1, 16))
    seconds = min(LONGEST_PAUSE, max(draw * bound, asked or 0.0))
    grid = min(interval, SHORTEST)
    return max(1, -(-int(-(-seconds // 1)) // grid)) * grid


def _at(day: datetime, clock: time, zone: str) -> datetime:
    return datetime.combine(day, clock, ZoneInfo(zone)).astimezone(timezone.utc)


def next_local(now: datetime, clock: time, zone: str = ZONE) -> datetime:
    """The first instant after ``now`` at which clocks there show that time."""
    today = now.astimezone(ZoneInfo(zone)).date()
    return next(t for t in (_at(today + timedelta(days=d), clock, zone) for d in range(3)) if t > now)


def next_nightly(now: datetime) -> datetime:
    return next_local(now, NIGHTLY)


def due(interval: int, now: datetime, fetched: datetime | None = None, updated: datetime | None = None, ttl: int = 0, retry: datetime | None = None, stored: datetime | None = None, zone: str = ZONE) -> datetime:
    """When a feed is to be polled next: after its interval, after its time to live, and not before a retry. A daily feed
    of which storage holds a snapshot of the local day waits for the next one."""
    times = [now] if fetched is None else [fetched + timedelta(seconds=interval)]
    if updated is not None and fetched is not None:
        times.append(updated + timedelta(seconds=ttl))
    if retry is not None:
        times.append(retry)
    if interval >= DAY and fetched is None and stored is not None:
        local = ZoneInfo(zone)
        if stored.astimezone(local).date() == now.astimezone(local).date():
            times.append(next_local(now, time(0), zone))
    return max(times)
