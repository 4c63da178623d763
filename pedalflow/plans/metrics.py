"""The availability metrics. Functions named ``*_rows`` are ungated plans; those of the public API apply the guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.localtime import clock, hour_of, local, local_date, seconds_between, time_of_day, weekday
from ..functions.values import day_type, propulsion_class, ratio
from ..operators.asof import asof_or_earliest
from ..operators.intervals import without_overlap
from ..operators.quantiles import exact_quantiles
from ..operators.scan import neighbours
from ..sources.catalog import Catalog
from .coverage import MetricResult, full_days, guard

MORNING = (frozenset(range(5)), "07:30", "08:30")
EIGHT = ("07:50:00", "08:00:00")
RAIN_MM, COLD_C = 0.1, 10.0

STATION = ["source", "station_id"]


def _weekday() -> Column:
    return weekday(local(F.col("snapshot_ts"))).cast("int").alias("weekday")


def _hour() -> Column:
    return F.hour(local(F.col("snapshot_ts"))).alias("local_hour")


def on_full_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    return rows.withColumn("local_date", local_date(F.col("snapshot_ts"))).join(days, "local_date", "left_semi")


# availability


def availability_rows(catalog: Catalog, by: str = "city") -> DataFrame:
    """Mean number of bikes over snapshots by local weekday and hour, for the city or each Bezirk. All snapshots count."""
    if by not in ("city", "bezirk"):
        raise ValueError(f"by is 'city' or 'bezirk', not {by!r}")
    rows, keys = catalog.table("station_status"), []
    if by == "bezirk":
        rows, keys = rows.join(catalog.table("station_areas"), STATION), ["bezirk"]
    totals = rows.groupBy("source", "snapshot_ts", *keys).agg(F.sum("num_bikes_available").alias("bikes"))
    return totals.groupBy(_weekday(), _hour(), *keys).agg(F.avg("bikes").alias("mean_bikes_available"), F.count("*").alias("n_snapshots"))


def availability_by_hour(catalog: Catalog, by: str = "city") -> MetricResult:
    rows = availability_rows(catalog, by)
    return guard("availability_by_hour", full_days(catalog), lambda: rows.orderBy("weekday", "local_hour", *rows.columns[2:-2]))


# empty minutes


def _median_seconds(intervals: DataFrame) -> DataFrame:
    """One row: the exact median length of all intervals between snapshots of a station."""
    return exact_quantiles(intervals.select("seconds"), [], "seconds", [0.5]).select(F.col("value").alias("median_seconds"))


def _in_window(window: tuple | None) -> Column:
    """Weekdays and times [from, to) of the local start; no weekday matches none."""
    if window is None:
        return F.lit(True)
    days, first, last = window
    wall = local(F.col("snapshot_ts"))
    return weekday(wall).isin(*(sorted(days) or [-1])) & (time_of_day(wall) >= clock(first)) & (time_of_day(wall) < clock(last))


def empty_seconds(catalog: Catalog, days: DataFrame, window: tuple | None = None) -> DataFrame:
    """Seconds that each station stood empty on full days, from a snapshot to the station's next one.

    An interval counts nothing when it is the last, is longer than twice the median of all, or any gap of the source
    overlaps it; it belongs to the day and the window of its start.
    """
    rows = catalog.table("station_status").select(*STATION, "snapshot_ts", "num_bikes_available", "is_installed")
    every = neighbours(rows, STATION, ["snapshot_ts"], after={"next_ts": "snapshot_ts"}).where("next_ts is not null").withColumn("seconds", seconds_between(F.col("snapshot_ts"), F.col("next_ts")))
    empty = on_full_days(every.where("num_bikes_available = 0 and is_installed").where(_in_window(window)), days)
    short = empty.join(F.broadcast(_median_seconds(every)), F.col("seconds") <= 2 * F.col("median_seconds"))  # one row
    free = without_overlap(short, catalog.table("gaps"), "source", "snapshot_ts", "next_ts")
    return free.groupBy(*STATION).agg(F.sum("seconds").alias("total_seconds"))


def _minutes(totals: DataFrame, days: DataFrame, *keys: str) -> DataFrame:
    n = days.agg(F.count("*").alias("_n"))
    minutes = F.col("total_seconds") / F.lit(60.0)
    return totals.where("total_seconds > 0").join(F.broadcast(n)).select(*keys, minutes.alias("empty_minutes_total"), (minutes / F.col("_n")).alias("empty_minutes_per_day"))


def empty_station_rows(catalog: Catalog, days: DataFrame, window: tuple | None = None) -> DataFrame:
    totals = empty_seconds(catalog, days, window).join(catalog.table("station_areas"), STATION)
    return _minutes(totals, days, "station_id", "bezirk", "ortsteil")


def empty_ortsteil_rows(catalog: Catalog, days: DataFrame, window: tuple | None = None) -> DataFrame:
    totals = empty_seconds(catalog, days, window).join(catalog.table("station_areas"), STATION)
    return _minutes(totals.groupBy("ortsteil", "bezirk").agg(F.sum("total_seconds").alias("total_seconds")), days, "ortsteil", "bezirk")


def share_empty_rows(catalog: Catalog, days: DataFrame) -> DataFrame:
    """One row: the mean share of installed stations that are empty in a full weekday's last snapshot from 07:50 to
    08:00; null without any."""
    wall = local(F.col("snapshot_ts"))
    near = catalog.table("station_status").where(weekday(wall).between(0, 4) & time_of_day(wall).between(*map(clock, EIGHT)))
    near = on_full_days(near, days)
    newest = F.max("snapshot_ts").over(Window.partitionBy("source", "local_date"))
    installed = F.count_if("is_installed").alias("installed")
    bare = F.count_if(F.col("is_installed") & (F.col("num_bikes_available") == 0)).alias("bare")
    per = near.withColumn("_last", newest).where("snapshot_ts = _last").groupBy("source", "snapshot_ts").agg(installed, bare)
    return per.where("installed > 0").agg(F.avg(ratio(F.col("bare"), F.col("installed"))).alias("share_empty_at_0800"))


def empty_minutes_by_station(catalog: Catalog, window: tuple | None = None) -> MetricResult:
    days = full_days(catalog)
    return guard("empty_minutes_by_station", days, lambda: empty_station_rows(catalog, days, window).orderBy(F.desc("empty_minutes_total"), "station_id"))


def empty_minutes_by_ortsteil(catalog: Catalog, window: tuple | None = None) -> MetricResult:
    days = full_days(catalog)
    return guard("empty_minutes_by_ortsteil", days, lambda: empty_ortsteil_rows(catalog, days, window).orderBy(F.desc("empty_minutes_total"), "ortsteil"))


def morning_shortage(catalog: Catalog) -> MetricResult:
    """Stations and Ortsteile of the morning window and the share at eight, as a dict of frames."""
    days = full_days(catalog)
    return guard(
        "morning_shortage",
        days,
        lambda: {"stations": empty_station_rows(catalog, days, MORNING), "ortsteile": empty_ortsteil_rows(catalog, days, MORNING), "share_empty_at_0800": share_empty_rows(catalog, days)},
    )


# flow


def net_flow_rows(catalog: Catalog, days: DataFrame) -> DataFrame:
    """Gains, losses and net change of bikes a day by day type, local hour and Bezirk.

    A station's change since its snapshot before counts in the later one's hour, unless the interval is longer than
    twice the median, a gap of the source overlaps it, or the later snapshot's day isn't full.
    """
    rows = catalog.table("station_status").select(*STATION, "snapshot_ts", "num_bikes_available")
    every = neighbours(rows, STATION, ["snapshot_ts"], before={"prev_ts": "snapshot_ts", "prev_bikes": "num_bikes_available"}).where("prev_ts is not null").withColumn("seconds", seconds_between(F.col("prev_ts"), F.col("snapshot_ts")))
    moved = on_full_days(every.withColumn("delta", F.col("num_bikes_available") - F.col("prev_bikes")).where("delta <> 0"), days)
    short = moved.join(F.broadcast(_median_seconds(every)), F.col("seconds") <= 2 * F.col("median_seconds"))  # one row
    free = without_overlap(short, catalog.table("gaps"), "source", "prev_ts", "snapshot_ts")
    wall = local(F.col("snapshot_ts"))
    hourly = free.join(catalog.table("station_areas"), STATION).groupBy(day_type(weekday(wall)).alias("day_type"), F.hour(wall).alias("local_hour"), "bezirk")
    sums = hourly.agg(F.sum(F.greatest("delta", F.lit(0))).alias("gains"), F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("losses"), F.sum("delta").alias("net"))
    # Two rows at most; a day type without full days has none and its flow goes.
    per_type = days.groupBy(day_type(weekday(F.col("local_date"))).alias("day_type")).agg(F.count("*").alias("n_days"))
    n = F.col("n_days")
    return sums.join(F.broadcast(per_type), "day_type").select(
        "day_type", "local_hour", "bezirk", *[(F.col(c).cast("double") / n).alias(f"{c}_per_day") for c in ("gains", "losses", "net")]
    )


def flow_between_rows(net: DataFrame) -> DataFrame:
    """Each losing Bezirk's whole net loss of an hour, split over the gaining ones by their gain. An hour's Bezirke are
    one row, so the net flow is computed once."""
    key = ["day_type", "local_hour"]
    hours = net.groupBy(*key).agg(F.collect_list(F.struct("bezirk", F.col("net_per_day").alias("net"))).alias("all"))
    gains = F.filter("all", lambda x: x["net"] > 0)
    total = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x["net"])
    lose = hours.select(*key, gains.alias("gains"), total.alias("total"), F.explode(F.filter("all", lambda x: x["net"] < 0)).alias("a"))
    both = lose.select(*key, "a", "total", F.explode("gains").alias("b"))
    return both.select(*key, F.col("a.bezirk").alias("from_bezirk"), F.col("b.bezirk").alias("to_bezirk"), (-F.col("a.net") * F.col("b.net") / F.col("total")).alias("bikes_per_day"))


def net_flow_by_bezirk(catalog: Catalog) -> MetricResult:
    days = full_days(catalog)
    return guard("net_flow_by_bezirk", days, lambda: net_flow_rows(catalog, days).orderBy("day_type", "local_hour", "bezirk"))


def flow_between_bezirke(catalog: Catalog) -> MetricResult:
    days = full_days(catalog)
    return guard("flow_between_bezirke", days, lambda: flow_between_rows(net_flow_rows(catalog, days)).orderBy("day_type", "local_hour", "from_bezirk", "to_bezirk"))


# footprint


def typed_entries(catalog: Catalog) -> DataFrame:
    """Bikes by vehicle type, at stations and free-floating: source, vehicle_type_id, snapshot_ts, bikes."""
    key = ["source", "snapshot_ts", "vehicle_type_id"]
    free = catalog.table("free_bike_cells").where("not at_station").select(*key, F.col("num_bikes").alias("bikes"))
    status = catalog.table("station_status")
    if "vehicle_types_available" not in status.columns:
        return free
    docked = status.select("source", "snapshot_ts", F.explode("vehicle_types_available").alias("e"))
    return docked.select("source", "snapshot_ts", "e.vehicle_type_id", F.col("e.count").alias("bikes")).unionByName(free)


def footprint_rows(catalog: Catalog, days: DataFrame) -> DataFrame:
    """Means over a full day's snapshots of bikes at stations, free-floating, and by propulsion.

    A type's propulsion is that of its latest sighting up to the snapshot, before the first one the earliest; types
    never seen are unknown. Free-floating totals belong to a snapshot of exactly their time.
    """
    status = catalog.table("station_status")
    at = ["source", "snapshot_ts"]
    totals = status.groupBy(*at).agg(F.sum("num_bikes_available").alias("docked"))
    floating = catalog.table("free_bike_cells").where("not at_station").groupBy(*at).agg(F.sum("num_bikes").alias("floating"))
    known = asof_or_earliest(typed_entries(catalog), catalog.table("vehicle_types"), ["source", "vehicle_type_id"], "snapshot_ts", "snapshot_ts", "propulsion_type")
    kind = propulsion_class(F.col("propulsion_type"))
    typed = known.groupBy(*at).agg(*[F.sum(F.when(kind == k, F.col("bikes")).otherwise(0)).alias(k) for k in ("ebike", "pedal", "unknown")])
    per_day = status.groupBy(local_date(F.col("snapshot_ts")).alias("local_date")).agg(F.countDistinct("station_id").alias("n_stations"))
    joined = on_full_days(totals.join(floating, at, "left").join(typed, at, "left"), days).join(per_day, "local_date")
    means = (("docked", "mean_bikes_at_stations"), ("floating", "mean_bikes_free_floating"), ("ebike", "mean_ebikes"), ("pedal", "mean_pedal_bikes"), ("unknown", "mean_unknown_type"))
    return joined.groupBy("local_date", "n_stations").agg(*[F.avg(F.coalesce(F.col(c), F.lit(0))).alias(name) for c, name in means])


def latest(rows: DataFrame, day: str = "local_date") -> DataFrame:
    """The row of the last day."""
    return rows.orderBy(F.desc(day)).limit(1)


def peak(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """The first row, in that order, of those with the highest value."""
    return rows.orderBy(F.desc(value), *order).limit(1)


def daily_footprint(catalog: Catalog) -> MetricResult:
    days = full_days(catalog)
    return guard("daily_footprint", days, lambda: footprint_rows(catalog, days).orderBy("local_date"))


# profiles


def newest_known(rows: DataFrame, keys: list[str], columns: list[str], time: str = "snapshot_ts") -> DataFrame:
    """Of each column its newest value that isn't null, so a row may mix several sightings."""
    return rows.groupBy(*keys).agg(*[F.expr(f"max_by({c}, {time}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in columns])


def station_profile_rows(catalog: Catalog, days: DataFrame) -> DataFrame:
    """Mean bikes by station, local weekday and hour on full days; stations without an area stay."""
    info = newest_known(catalog.table("station_information"), STATION, ["name", "lat", "lon"])
    local_rows = on_full_days(catalog.table("station_status"), days)
    means = local_rows.groupBy(*STATION, _weekday(), _hour()).agg(F.avg("num_bikes_available").alias("mean_bikes_available"), F.count("*").alias("n_snapshots"))
    areas = catalog.table("station_areas").select(*STATION, "ortsteil")
    return means.join(info, STATION).join(areas, STATION, "left").select("station_id", "name", "lat", "lon", "ortsteil", "weekday", "local_hour", "mean_bikes_available", "n_snapshots")


def ortsteil_profile_rows(catalog: Catalog, days: DataFrame) -> DataFrame:
    rows = on_full_days(catalog.table("station_status"), days).join(catalog.table("station_areas"), STATION)
    totals = rows.groupBy("ortsteil", "snapshot_ts").agg(F.sum("num_bikes_available").alias("bikes"))
    return totals.groupBy("ortsteil", _weekday(), _hour()).agg(F.avg("bikes").alias("mean_bikes_available"), F.count("*").alias("n_snapshots"))


def station_profiles(catalog: Catalog) -> MetricResult:
    days = full_days(catalog)
    return guard("station_profiles", days, lambda: station_profile_rows(catalog, days).orderBy("station_id", "weekday", "local_hour"))


def ortsteil_profiles(catalog: Catalog) -> MetricResult:
    days = full_days(catalog)
    return guard("ortsteil_profiles", days, lambda: ortsteil_profile_rows(catalog, days).orderBy("ortsteil", "weekday", "local_hour"))


def profile_curves(profiles: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """For each key a 7 by 24 array of rounded means, null where there is none."""
    cell = F.struct((F.col("weekday") * 24 + F.col("local_hour")).alias("at"), F.round("mean_bikes_available", digits).alias("mean"))
    packed = profiles.groupBy(key).agg(F.map_from_entries(F.collect_list(cell)).alias("_m"))
    curve = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at(F.col("_m"), d * 24 + h)))
    return packed.select(key, curve.alias("curves"))


# weather


def snapshot_weather(catalog: Catalog) -> DataFrame:
    """Station rows with the weather of their UTC hour and whether that is missing."""
    weather = catalog.table("weather").select("hour_ts", "precipitation_mm", "temperature_c", F.lit(False).alias("_none"))
    rows = catalog.table("station_status").withColumn("hour_ts", hour_of(F.col("snapshot_ts"))).join(weather, "hour_ts", "left")
    return rows.select("*", F.coalesce("_none", F.lit(True)).alias("weather_missing"), local(F.col("snapshot_ts")).alias("local_ts")).drop("_none", "hour_ts")


def create_snapshot_weather_view(catalog: Catalog) -> None:
    snapshot_weather(catalog).createOrReplaceTempView("snapshot_weather")


def weather_rows(catalog: Catalog, kind: str) -> DataFrame:
    """Means by weather bucket and local hour; snapshots without the measured value are one excluded row without hour.

    A snapshot without installed stations has no empty share (null) instead of a division by zero.
    """
    if kind not in ("rain", "temperature"):
        raise ValueError(f"kind is 'rain' or 'temperature', not {kind!r}")
    value = F.col("precipitation_mm" if kind == "rain" else "temperature_c")
    active = F.when(value >= RAIN_MM, "rainy").otherwise("dry") if kind == "rain" else F.when(value < COLD_C, "cold").otherwise("warm")
    per = snapshot_weather(catalog).groupBy("snapshot_ts", "local_ts").agg(
        F.max("precipitation_mm").alias("precipitation_mm"),
        F.max("temperature_c").alias("temperature_c"),
        F.bool_or("weather_missing").alias("missing"),
        F.sum("num_bikes_available").alias("bikes"),
        F.count_if("is_installed").alias("installed"),
        F.count_if(F.col("is_installed") & (F.col("num_bikes_available") == 0)).alias("bare"),
    )
    out = F.col("missing") | value.isNull()
    classed = per.withColumn("bucket", F.when(out, "excluded").otherwise(active)).withColumn("local_hour", F.when(~out, F.hour("local_ts")))
    shown = F.col("bucket") != "excluded"
    return (
        classed.groupBy("bucket", "local_hour")
        .agg(F.avg("bikes").alias("b"), F.avg(ratio(F.col("bare"), F.col("installed"))).alias("s"), F.count("*").alias("n_snapshots"), F.countDistinct(hour_of(F.col("snapshot_ts"))).alias("n_hours"))
        .select("bucket", "local_hour", F.when(shown, F.col("b")).alias("mean_bikes_available"), F.when(shown, F.col("s")).alias("empty_station_share"), "n_snapshots", "n_hours")
    )


#: What hours of a kind are told apart as.
WEATHER_BUCKETS = {"rain": ("rainy", "dry"), "temperature": ("cold", "warm")}


def weather_buckets(catalog: Catalog, kind: str) -> DataFrame:
    """How many snapshots each bucket of a kind has; ``missing`` is one that has none, with no curve to show."""
    found = weather_rows(catalog, kind)
    counted = [F.struct(F.lit(b).alias("bucket"), F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n_snapshots"))), F.lit(0)).alias("n_snapshots")) for b in WEATHER_BUCKETS[kind]]
    rows = found.agg(F.array(*counted).alias("_all")).select(F.inline("_all"))
    return rows.select(F.lit(kind).alias("kind"), "bucket", "n_snapshots", (F.col("n_snapshots") == 0).alias("missing"))


def weather_effect(catalog: Catalog, kind: str) -> MetricResult:
    rows = weather_rows(catalog, kind)
    rank = F.when(F.col("bucket").isin("rainy", "cold"), 0).when(F.col("bucket").isin("dry", "warm"), 1).otherwise(2)
    return guard("weather_effect", full_days(catalog), lambda: rows.orderBy(rank, F.asc_nulls_last("local_hour")))
