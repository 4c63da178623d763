"""Wall-clock columns from UTC instants. Instants are timestamps without zone that mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"


def instant(ts: Column) -> Column:
    """An instant with a zone as UTC without one; a timestamp without zone stays."""
    return ts.cast("timestamp_ntz")


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def utc(wall: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def weekday(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(ts)


def sunday_first(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def hour_of(ts: Column) -> Column:
    """The full hour that an instant lies in, without zone."""
    return F.date_trunc("HOUR", ts).cast("timestamp_ntz")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a UTC instant."""
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries crossed from a to b."""
    return epoch(b) - epoch(a)


def start_of(day: Column, zone: str = ZONE) -> Column:
    """The UTC instant at which a local day begins."""
    return utc(day.cast("timestamp_ntz"), zone)


def time_of_day(wall: Column) -> Column:
    """Seconds since local midnight, as the clock shows them."""
    return F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def clock(text: str) -> int:
    """'07:30' or '07:30:15' as seconds since midnight."""
    parts = [int(x) for x in text.split(":")]
    return sum(p * s for p, s in zip(parts, (3600, 60, 1), strict=False))
