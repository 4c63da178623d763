"""Scalar helpers: cleaning, labels, buckets and curves."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on station ids keep two decimals; before, trailing zero decimals were an artefact.
STATION_ID_CHANGE = "2021-02-01"

#: The holidays that weekday analyses leave out.
HOLIDAYS = (
    "2013-07-04", "2013-09-02", "2013-11-28", "2013-11-29", "2013-12-24", "2013-12-25",
    "2014-01-01", "2014-01-20", "2014-02-17", "2014-05-26", "2014-07-04", "2014-09-01",
    "2014-11-27", "2014-11-28", "2014-12-24", "2014-12-25",
    "2015-01-01", "2015-01-19", "2015-02-16", "2015-05-25", "2015-07-03", "2015-09-07",
    "2015-11-26", "2015-11-27", "2015-12-24", "2015-12-25",
)


def station_id(raw: Column, start: Column) -> Column:
    """A station id in one spelling. Null where either input is."""
    late = F.when(raw.rlike(r"^\d+\.\d$"), F.concat(raw, F.lit("0"))).otherwise(raw)
    early = F.regexp_replace(raw, r"\.00?$", "")
    return F.when(start >= F.lit(STATION_ID_CHANGE).cast("timestamp_ntz"), late).when(start.isNotNull(), early)


def clean_int(raw: Column) -> Column:
    """'' and 'NULL' are null; '1969.0' is 1969."""
    text = F.nullif(F.nullif(raw, F.lit("")), F.lit("NULL"))
    return F.round(text.try_cast("decimal(20,6)")).cast("int")


def zero_is_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("double"))


def is_holiday(day: Column) -> Column:
    return day.isin([F.lit(d).cast("date") for d in HOLIDAYS])


def day_type(weekday: Column) -> Column:
    return F.when(weekday <= 4, F.lit("weekday")).otherwise(F.lit("weekend"))


def propulsion_class(kind: Column) -> Column:
    return F.when(kind == "human", "pedal").when(kind.isin("electric_assist", "electric"), "ebike").otherwise("unknown")


def left_closed(value: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """The label of the bin [a, b) that a value lies in; null outside all."""
    names = labels or [f"[{a:g},{b:g})" for a, b in pairwise(edges)]
    out = None
    for (a, b), name in zip(pairwise(edges), names, strict=True):
        inside = (value >= a) & (value < b)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out


def step_bin(value: Column, bounds: tuple[float, ...] = (0.0, 0.05, 1.0, 3.0)) -> Column:
    """The number of the highest lower bound that a mean reaches, as map colours are chosen; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i in reversed(range(len(bounds))):
        out = out.when(value >= bounds[i], F.lit(i))
    return out.otherwise(F.lit(0))


def s_curve(x: Column, center: float | Column, width: float | Column) -> Column:
    return 1 / (1 + F.exp((F.lit(0) + center - x) / width))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded, ties to the even digit."""
    return F.bround(x, digits)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_")


def relabel(level: Column, labels: dict) -> Column:
    """Levels under other names, as text; one without a new name keeps its own, null stays null."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(names, level), level.cast("string"))


def ellipsis(text: Column, most: int = 17) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def axis_ticks(top: Column, about: int = 5) -> Column:
    """Ticks from 0 to the first one at or above ``top``, a step of 1, 2 or 5 times a power of ten apart and about so
    many. Nothing above 0: the tick 0 alone."""
    raw = top / about
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    step = F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0) * power
    count = F.ceil(top / step - 1e-9).cast("int")
    return F.when(top > 0, F.transform(F.sequence(F.lit(0), count), lambda k: F.round(k * step, 9))).otherwise(F.array(F.lit(0.0)))


def pseudonym(ident: Column, salt: str) -> Column:
    """A name for an id that gives the same name again and doesn't tell the id; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), ident.cast("string")), 256), 1, 16)
