"""Trip analyses: pairs, rush hours, activity, relocation, privacy, distributions, stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.localtime import sunday_first
from ..functions.values import clean_int, is_holiday, left_closed, station_id, zero_is_null
from ..operators.intervals import trailing_distinct
from ..operators.quantiles import ACCURACY, exact_quantiles
from ..operators.scan import neighbours

PAIR = ["start_station_id", "end_station_id"]
RUSH_HOURS = (7, 8, 9, 17, 18, 19)


def _day() -> Column:
    return F.to_date("start_time").alias("date")


def split_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned station trips, and dockless ones: rows where either station id is null."""
    docked = raw.where("start_station_id is not null and end_station_id is not null")
    loose = raw.where("start_station_id is null or end_station_id is null")
    people = {"birth_year": clean_int(F.col("birth_year")), "gender": clean_int(F.col("gender"))}
    ends = [(f"{e}_station_{x}", f"{e}_{x}") for e in ("start", "end") for x in ("latitude", "longitude")]
    trips = docked.withColumns(
        people
        | {f"{e}_station_id": station_id(F.col(f"{e}_station_id"), F.col("start_time")) for e in ("start", "end")}
        | {new: zero_is_null(F.col(old)) for old, new in ends}
    ).drop(*[old for old, _ in ends])
    other = loose.withColumns(people).withColumnsRenamed(dict(ends)).drop("start_station_id", "end_station_id", "start_station_name", "end_station_name")
    return trips, other


def weekday_trips(trips: DataFrame) -> DataFrame:
    return trips.where(sunday_first(F.col("start_time")).between(1, 5))


def rush_hour(trips: DataFrame, holidays: bool = True) -> DataFrame:
    """Weekday trips of the rush hours, without holidays unless they are wanted."""
    rows = weekday_trips(trips).where(F.hour("start_time").isin(*RUSH_HOURS))
    return rows if holidays else rows.where(~is_holiday(F.to_date("start_time")))


#: Places that rows are dealt to before an aggregate over very many keys; an executor's tasks take several each.
PLACES = 4096


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """These columns, dealt by their hash, so that a partial aggregate by them meets a key in few tasks: else each
    task of a large scan holds nearly as many groups as rows. Adaptive execution merges small places and parts large
    ones, as where one key has most rows; the aggregate that follows works on any such parting."""
    return rows.select(*keys, F.pmod(F.hash(*keys), F.lit(PLACES)).alias("_place")).hint("rebalance", "_place").select(*keys)


def pair_counts(trips: DataFrame) -> DataFrame:
    return gathered(trips, *PAIR).groupBy(*PAIR).agg(F.count("*").alias("trips"))


def named_pairs(pairs: DataFrame, stations: DataFrame) -> DataFrame:
    """Pairs with both stations' names and areas."""
    side = lambda e: stations.select(F.col("station_id").alias(f"{e}_station_id"), F.col("name").alias(f"{e}_name"), F.col("ntaname").alias(f"{e}_ntaname"), F.col("boroname").alias(f"{e}_boroname"))
    return pairs.join(side("start"), "start_station_id").join(side("end"), "end_station_id")


def area_flows(pairs: DataFrame, stations: DataFrame) -> DataFrame:
    return named_pairs(pairs, stations).groupBy("start_ntaname", "end_ntaname").agg(F.sum("trips").alias("total"))


def legs_of(points: DataFrame, key: str, position: str) -> DataFrame:
    """Neighbouring points of a path as legs: key, number, both ends."""
    path = Window.partitionBy(key).orderBy(position)
    ahead = points.withColumns({"end_lon": F.lead("lon").over(path), "end_lat": F.lead("lat").over(path)})
    return ahead.where("end_lon is not null").select(key, F.col(position).alias("number"), F.col("lon").alias("start_lon"), F.col("lat").alias("start_lat"), "end_lon", "end_lat")


def legs_of_paths(paths: DataFrame, key: str, path: str) -> DataFrame:
    """As legs_of, of paths that come as arrays of (lon, lat): each is cut where it lies, no row is sorted again."""
    starts = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
    legs = F.transform(starts, lambda p, i: F.struct(p["lon"].alias("start_lon"), p["lat"].alias("start_lat"), F.get(path, i + 1)["lon"].alias("end_lon"), F.get(path, i + 1)["lat"].alias("end_lat")))
    return paths.select(key, F.posexplode(legs).alias("number", "leg")).select(key, "number", "leg.*")


def leg_counts(legs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Trips over every leg, by its coordinates."""
    return legs.join(pairs, PAIR).groupBy("start_lon", "start_lat", "end_lon", "end_lat").agg(F.sum("trips").alias("trips"))


def expected_durations(legs: DataFrame) -> DataFrame:
    """Sum of the legs' durations and of their lengths on the sphere, by pair."""
    metres = haversine(F.col("start_lon"), F.col("start_lat"), F.col("end_lon"), F.col("end_lat"))
    return legs.groupBy(*PAIR).agg(F.sum("duration").alias("duration"), F.sum(metres).alias("metres"))


def daily_trips(trips: DataFrame, *keys: str) -> DataFrame:
    return trips.groupBy(_day(), *keys).agg(F.count("*").alias("trips"))


def with_daily_weather(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Days that have weather, with calendar columns."""
    return daily.join(weather, "date").withColumns({"dow": sunday_first(F.col("date")), "year": F.year("date"), "month": F.month("date"), "holiday": is_holiday(F.col("date"))})


def active_stations(trips: DataFrame, days: int = 28) -> DataFrame:
    """Distinct stations, at either end, over the trailing days."""
    both = trips.select("start_time", F.col("start_station_id").alias("id")).unionByName(trips.select("start_time", F.col("end_station_id").alias("id")))
    return trailing_distinct(both, "start_time", "id", days, "stations")


def active_bikes(trips: DataFrame, days: int = 28) -> DataFrame:
    return trailing_distinct(trips, "start_time", "bike_id", days, "bikes")


def hourly(trips: DataFrame) -> DataFrame:
    weekday = sunday_first(F.col("start_time")).between(1, 5).alias("weekday")
    return trips.groupBy(F.hour("start_time").alias("hour"), weekday).agg(F.count("*").alias("trips"), F.countDistinct(F.to_date("start_time")).alias("number_of_days"))


def boros_hourly(trips: DataFrame, stations: DataFrame, inner: str = "Manhattan", others: str = "Outer Boroughs") -> DataFrame:
    """Weekday trips by hour between the inner area and the others, and on how many days."""
    per = weekday_trips(trips).groupBy(_day(), F.hour("start_time").alias("hour"), *PAIR).agg(F.count("*").alias("trips"))
    group = lambda c: F.when(F.col(c) == inner, inner).otherwise(others)
    named = named_pairs(per, stations)
    return named.groupBy("hour", group("start_boroname").alias("start_boro"), group("end_boroname").alias("end_boro")).agg(F.sum("trips").alias("total"), F.countDistinct("date").alias("number_of_days"))


def drop_offs(trips: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Every trip that its bike has another after, with that one's start: the order must be total."""
    ahead = neighbours(trips, ["bike_id"], order, after={"next_start_station_id": "start_station_id", "next_start_time": "start_time"})
    return ahead.where("next_start_station_id is not null")


def transports(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Drop-offs, and those whose bike next started elsewhere."""
    moved = (F.col("end_station_id") != F.col("next_start_station_id")).cast("int")
    return rows.groupBy("end_station_id", *keys).agg(F.count("*").alias("total_drop_offs"), F.sum(moved).alias("transported"))


def transport_share(counts: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Share of transported bikes, of groups with more than ``least`` drop-offs."""
    sums = counts.groupBy(*keys).agg(F.sum("transported").alias("_t"), F.sum("total_drop_offs").alias("total"))
    return sums.where(F.col("total") > least).select(*keys, (F.col("_t").cast("double") / F.col("total")).alias("frac"), "total")


def anonymity_counts(trips: DataFrame, unit: str) -> DataFrame:
    """Trips that share start hour or day, station, gender and age: subscribers of known gender, born from 1920 on."""
    start = F.date_trunc("HOUR", "start_time").cast("timestamp_ntz") if unit == "hour" else F.to_date("start_time")
    known = trips.where("user_type = 'Subscriber' and gender in (1, 2) and birth_year >= 1920")
    return known.groupBy(start.alias("truncated"), "start_station_id", "gender", (F.year("start_time") - F.col("birth_year")).alias("age")).agg(F.count("*").alias("trips"))


def unique_share(counts: DataFrame, *keys: str) -> DataFrame:
    """The part of trips that are alone in their group."""
    return counts.groupBy(*keys).agg((F.count_if(F.col("trips") == 1).cast("double") / F.sum("trips")).alias("uniq_frac"), F.sum("trips").alias("total"))


def trailing_sum(daily: DataFrame, rows: int = 28) -> DataFrame:
    """Sum over the last rows up to each day; null until there are so many."""
    # One row here is a day.
    past = Window.orderBy("date").rowsBetween(-(rows - 1), 0)
    return daily.withColumn("trailing", F.when(F.count("*").over(past) == rows, F.sum("trips").over(past)))


def trip_speeds(trips: DataFrame) -> DataFrame:
    """Hours, miles and miles an hour of trips; miles are the quantity here, hours the days between start and stop."""
    hours = (F.abs(F.datediff("stop_time", "start_time")) + 1).cast("double")
    return trips.withColumns({"hours": hours, "miles": F.col("l_quantity")}).withColumn("mph", F.col("miles") / F.col("hours"))


def speed_summary(trips: DataFrame, edges: list[float], least: int = 3) -> DataFrame:
    """Mean, median, deviation and number of speeds by gender and distance bin, of groups of at least ``least``."""
    rows = trip_speeds(trips).where("mph > 0.05 and mph < 35").withColumn("bin", left_closed(F.col("miles"), edges)).where("bin is not null")
    more = [F.avg("mph").alias("mean"), F.stddev_samp("mph").alias("sd"), F.count("*").alias("n")]
    return exact_quantiles(rows.select("gender", "bin", "mph"), ["gender", "bin"], "mph", [0.5], more).where(F.col("n") >= least).select("gender", "bin", "mean", F.col("value").alias("median"), "sd", "n")


def seen_at_either_end(stations: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Stations at which one of some trips starts or one of some others ends."""
    ids = starts.select(F.col("start_station_id").alias("station_id")).unionByName(ends.select(F.col("end_station_id").alias("station_id")))
    return stations.join(ids.distinct(), "station_id", "left_semi")


def quantiles(rows: DataFrame, column: str, at: tuple[float, ...] = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99), accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles, linear between neighbours, one row each; null without any value."""
    found = exact_quantiles(rows.select(column), [], column, at, accuracy=accuracy)
    asked = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in at])).alias("p"))
    return asked.join(found, "p", "left")


def mean_by(rows: DataFrame, key: Column, value: str = "trips", least: int = 1) -> DataFrame:
    return rows.groupBy(key.alias("bucket")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def stations_from_trips(ends: DataFrame, known: DataFrame) -> DataFrame:
    """Stations that no known list has: of each id the most frequent name and rounded place among distinct
    sightings (ties by name and place, nulls last). ``ends``: station_id, name, latitude, longitude."""
    new = ends.where("station_id is not null").distinct().join(known.select(F.col("normalized_id").alias("station_id")), "station_id", "left_anti")
    place = ["station_id", "name", F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude")]
    counts = new.groupBy(*place).agg(F.count("*").alias("trips"))
    # Smallest first: fewer trips negated, and of equal ones a null after everything else.
    order = [-F.col("trips"), *[x for c in ("name", "latitude", "longitude") for x in (F.col(c).isNull(), F.col(c))]]
    best = counts.groupBy("station_id").agg(F.min_by(F.struct("name", "latitude", "longitude"), F.struct(*[x.alias(f"_{k}") for k, x in enumerate(order)])).alias("_best"))
    return best.select(F.col("station_id").alias("normalized_id"), "_best.name", "_best.latitude", "_best.longitude", F.lit("trips_data").alias("data_source"))
