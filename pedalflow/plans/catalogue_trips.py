"""Queries over the trip relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import decode_polyline, encode_polyline, rounded_rings
from ..functions.localtime import sunday_first
from ..functions.values import HOLIDAYS, axis_ticks, clean_int, half_even, station_id
from ..operators.bitmaps import daily_states, trailing_counts
from ..sources import bridge
from ..sources.bridge import with_views
from ..sources.storage import delete_where, update_from, upsert
from . import models, trips

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


DOW = "dayofweek(start_time)"
RUSH = f"{DOW} BETWEEN 1 AND 5 AND hour(start_time) IN (7, 8, 9, 17, 18, 19)"
HOLIDAY_LIST = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    """Trips whose start hour follows the order key, as the driver's dates have none."""
    return bridge.trips(spark, d).withColumn("start_time", (F.col("start_time") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))).cast("timestamp_ntz"))


SHIFTED = "tr AS (SELECT * REPLACE (start_time + to_hours(CAST(l_orderkey % 24 AS INT)) AS start_time) FROM trips)"


@query("SELECT start_station_id, end_station_id, count(*) AS trips FROM trips GROUP BY 1, 2", "trips")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return trips.pair_counts(bridge.trips(spark, d))


@query(SHIFTED + f" SELECT start_station_id, end_station_id, count(*) AS trips FROM tr WHERE {RUSH} GROUP BY 1, 2", "trips")
def rush_hour_pairs(spark: SparkSession, d: str) -> DataFrame:
    return trips.pair_counts(trips.rush_hour(_shifted(spark, d)))


@query(SHIFTED + f" SELECT CAST(start_time AS DATE) AS date, count(*) AS trips FROM tr WHERE {RUSH} AND CAST(start_time AS DATE) NOT IN ({HOLIDAY_LIST}) GROUP BY 1", "trips")
def weekday_rush_hour(spark: SparkSession, d: str) -> DataFrame:
    return trips.daily_trips(trips.rush_hour(_shifted(spark, d), holidays=False))


@query(
    """pc AS (SELECT start_station_id, end_station_id, count(*) AS t FROM trips GROUP BY 1, 2)
SELECT s.ntaname AS start_ntaname, e.ntaname AS end_ntaname, CAST(sum(t) AS BIGINT) AS total FROM pc JOIN stations s ON s.station_id = start_station_id
JOIN stations e ON e.station_id = end_station_id GROUP BY 1, 2""",
    "trips", "stations",
)
def area_flows(spark: SparkSession, d: str) -> DataFrame:
    return trips.area_flows(trips.pair_counts(bridge.trips(spark, d)), bridge.stations(spark, d))


@query(
    SHIFTED
    + f""", h AS (SELECT CAST(start_time AS DATE) AS date, hour(start_time) AS hour, start_station_id, end_station_id, count(*) AS t FROM tr WHERE {DOW} BETWEEN 1 AND 5 GROUP BY ALL)
SELECT CAST(hour AS INT) AS hour, CASE WHEN s.boroname = 'EUROPE' THEN 'EUROPE' ELSE 'Outer' END AS start_boro, CASE WHEN e.boroname = 'EUROPE' THEN 'EUROPE' ELSE 'Outer' END AS end_boro,
  CAST(sum(t) AS BIGINT) AS total, count(DISTINCT date) AS number_of_days
FROM h JOIN stations s ON s.station_id = start_station_id JOIN stations e ON e.station_id = end_station_id GROUP BY 1, 2, 3""",
    "trips", "stations",
)
def boros_hourly(spark: SparkSession, d: str) -> DataFrame:
    return trips.boros_hourly(_shifted(spark, d), bridge.stations(spark, d), "EUROPE", "Outer")


def _legs(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's way: from its start over a middle point to its end."""
    s = bridge.stations(spark, d)
    pairs = trips.pair_counts(bridge.trips(spark, d)).where("start_station_id <> end_station_id").select(*trips.PAIR)
    a = s.select(F.col("station_id").alias("start_station_id"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    b = s.select(F.col("station_id").alias("end_station_id"), F.col("lon").alias("blon"), F.col("lat").alias("blat"))
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    path = pairs.join(a, "start_station_id").join(b, "end_station_id").withColumn(
        "p", F.array(point(F.col("alon"), F.col("alat")), point(F.col("alon"), F.col("blat")), point(F.col("blon"), F.col("blat")))
    )
    points = path.select(F.concat_ws("-", *trips.PAIR).alias("key"), *trips.PAIR, F.posexplode("p").alias("number", "q")).select("key", *trips.PAIR, "number", "q.*")
    legs = trips.legs_of(points, "key", "number")
    return legs.join(points.select("key", *trips.PAIR).distinct(), "key").withColumn("duration", (F.col("number") + 1) * 60.0)


LEGS = """pc AS (SELECT start_station_id, end_station_id, count(*) AS t FROM trips GROUP BY 1, 2),
pt AS (SELECT start_station_id, end_station_id, t, unnest([0, 1]) AS number, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat
  FROM pc JOIN stations a ON a.station_id = start_station_id JOIN stations b ON b.station_id = end_station_id WHERE start_station_id <> end_station_id),
lg AS (SELECT start_station_id, end_station_id, t, number, alon AS start_lon, CASE number WHEN 0 THEN alat ELSE blat END AS start_lat,
  CASE number WHEN 0 THEN alon ELSE blon END AS end_lon, blat AS end_lat, (number + 1) * 60.0::DOUBLE AS duration FROM pt)"""


@query(LEGS + " SELECT start_lon, start_lat, end_lon, end_lat, CAST(sum(t) AS BIGINT) AS trips FROM lg GROUP BY 1, 2, 3, 4", "trips", "stations")
def leg_counts(spark: SparkSession, d: str) -> DataFrame:
    return trips.leg_counts(_legs(spark, d), trips.pair_counts(bridge.trips(spark, d)))


@query(
    LEGS
    + """ SELECT start_station_id, end_station_id, sum(duration) AS duration, round(sum(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(end_lat - start_lat) / 2), 2)
  + cos(radians(start_lat)) * cos(radians(end_lat)) * pow(sin(radians(end_lon - start_lon) / 2), 2))))), 3) AS metres FROM lg GROUP BY 1, 2""",
    "trips", "stations",
)
def expected_durations(spark: SparkSession, d: str) -> DataFrame:
    return trips.expected_durations(_legs(spark, d)).withColumn("metres", F.round("metres", 3))


CALENDAR = f"CAST(dayofweek(date) AS INT) AS dow, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, date IN ({HOLIDAY_LIST}) AS holiday"


@query(f"t AS (SELECT CAST(start_time AS DATE) AS date, count(*) AS trips FROM trips GROUP BY 1) SELECT t.*, precipitation, max_temperature, snow_depth, {CALENDAR} FROM t JOIN daily_weather USING (date)", "trips", "daily_weather")
def daily_with_weather(spark: SparkSession, d: str) -> DataFrame:
    return trips.with_daily_weather(trips.daily_trips(bridge.trips(spark, d)), bridge.daily_weather(spark, d))


@query(
    f"t AS (SELECT CAST(start_time AS DATE) AS date, start_station_id, count(*) AS trips FROM trips GROUP BY 1, 2) SELECT t.*, precipitation, max_temperature, snow_depth, {CALENDAR}, name, boroname "
    "FROM t JOIN daily_weather USING (date) JOIN stations ON station_id = start_station_id",
    "trips", "daily_weather", "stations",
)
def station_daily_with_weather(spark: SparkSession, d: str) -> DataFrame:
    daily = trips.with_daily_weather(trips.daily_trips(bridge.trips(spark, d), "start_station_id"), bridge.daily_weather(spark, d))
    return daily.join(bridge.stations(spark, d).select(F.col("station_id").alias("start_station_id"), "name", "boroname"), "start_station_id")


def _trailing(source: str, name: str) -> str:
    return f"""u AS ({source}), c AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM u)
SELECT c.date, count(DISTINCT id) AS {name} FROM c JOIN u ON u.date <= c.date AND u.date >= c.date - 27 GROUP BY 1"""


@query(_trailing("SELECT DISTINCT CAST(start_time AS DATE) AS date, bike_id AS id FROM trips", "bikes"), "trips")
def active_28d_bikes(spark: SparkSession, d: str) -> DataFrame:
    return trips.active_bikes(bridge.trips(spark, d))


@query(_trailing("SELECT DISTINCT CAST(start_time AS DATE) AS date, bike_id AS id FROM trips", "bikes"), "trips")
def active_28d_bikes_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same from bitmaps a day."""
    return trailing_counts(daily_states(bridge.trips(spark, d), "start_time", "bike_id"), 28, "bikes")


@query(_trailing("SELECT CAST(start_time AS DATE) AS date, start_station_id AS id FROM trips UNION SELECT CAST(start_time AS DATE), end_station_id FROM trips", "stations"), "trips")
def active_28d_stations(spark: SparkSession, d: str) -> DataFrame:
    return trips.active_stations(bridge.trips(spark, d))


@query(SHIFTED + f" SELECT CAST(hour(start_time) AS INT) AS hour, {DOW} BETWEEN 1 AND 5 AS weekday, count(*) AS trips, count(DISTINCT CAST(start_time AS DATE)) AS number_of_days FROM tr GROUP BY 1, 2", "trips")
def hourly_weekday(spark: SparkSession, d: str) -> DataFrame:
    return trips.hourly(_shifted(spark, d))


NEXT = f"""nx AS (SELECT *, lead(start_station_id) OVER (PARTITION BY bike_id ORDER BY {', '.join(bridge.TRIP_ORDER)}) AS n FROM trips),
dr AS (SELECT * FROM nx WHERE n IS NOT NULL)"""


def _moved(keys: str = "") -> str:
    return f" SELECT end_station_id, {keys} count(*) AS total_drop_offs, CAST(count(*) FILTER (end_station_id <> n) AS BIGINT) AS transported FROM dr GROUP BY ALL"


def _drops(spark: SparkSession, d: str) -> DataFrame:
    return trips.drop_offs(bridge.trips(spark, d), bridge.TRIP_ORDER)


@query(NEXT + _moved(), "trips")
def bike_transports(spark: SparkSession, d: str) -> DataFrame:
    return trips.transports(_drops(spark, d))


@query(NEXT + _moved("CAST(date_trunc('month', stop_time) AS DATE) AS month,"), "trips")
def transports_monthly(spark: SparkSession, d: str) -> DataFrame:
    return trips.transports(_drops(spark, d), F.to_date(F.date_trunc("MONTH", "stop_time")).alias("month"))


@query(
    NEXT + """, c AS (SELECT end_station_id, CAST(day(stop_time) % 24 AS INT) AS hour, n, 1 AS one FROM dr)
SELECT ntaname, hour, CAST(count(*) FILTER (end_station_id <> n) AS DOUBLE) / count(*) AS frac, count(*) AS total FROM c JOIN stations ON station_id = end_station_id GROUP BY 1, 2 HAVING count(*) > 5""",
    "trips", "stations",
)
def transports_hourly_having(spark: SparkSession, d: str) -> DataFrame:
    counts = trips.transports(_drops(spark, d), (F.dayofmonth("stop_time") % 24).cast("int").alias("hour"))
    named = counts.join(bridge.stations(spark, d).select(F.col("station_id").alias("end_station_id"), "ntaname"), "end_station_id")
    return trips.transport_share(named, "ntaname", "hour", least=5)


def _anonymous(unit: str) -> str:
    start = "date_trunc('hour', start_time)" if unit == "hour" else "CAST(start_time AS DATE)"
    return f"""an AS (SELECT {start} AS t, start_station_id, gender, year(start_time) - birth_year AS age, count(*) AS c FROM trips
  WHERE user_type = 'Subscriber' AND gender IN (1, 2) AND birth_year >= 1920 GROUP BY 1, 2, 3, 4)"""


UNIQUE = "CAST(count(*) FILTER (c = 1) AS DOUBLE) / sum(c) AS uniq_frac, CAST(sum(c) AS BIGINT) AS total FROM an"


@query(_anonymous("hour") + " SELECT " + UNIQUE, "trips")
def uniqueness_hourly(spark: SparkSession, d: str) -> DataFrame:
    return trips.unique_share(trips.anonymity_counts(bridge.trips(spark, d), "hour"))


@query(_anonymous("day") + " SELECT " + UNIQUE, "trips")
def uniqueness_daily(spark: SparkSession, d: str) -> DataFrame:
    return trips.unique_share(trips.anonymity_counts(bridge.trips(spark, d), "day"))


@query(_anonymous("day") + " SELECT gender, CAST(age AS INT) AS age, " + UNIQUE + " GROUP BY 1, 2", "trips")
def uniqueness_by_age(spark: SparkSession, d: str) -> DataFrame:
    return trips.unique_share(trips.anonymity_counts(bridge.trips(spark, d), "day"), "gender", "age")


DAILY = "dt AS (SELECT CAST(start_time AS DATE) AS date, count(*) AS trips FROM trips GROUP BY 1)"


@query(DAILY + " SELECT date, trips, CASE WHEN count(*) OVER w = 28 THEN CAST(sum(trips) OVER w AS BIGINT) END AS trailing FROM dt WINDOW w AS (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)", "trips")
def trailing_28d_sum(spark: SparkSession, d: str) -> DataFrame:
    return trips.trailing_sum(trips.daily_trips(bridge.trips(spark, d)))


@query(DAILY + " SELECT CAST(dayofweek(date) AS INT) AS bucket, avg(trips) AS mean, count(*) AS n FROM dt GROUP BY 1", "trips")
def dow_mean(spark: SparkSession, d: str) -> DataFrame:
    return trips.mean_by(trips.daily_trips(bridge.trips(spark, d)), sunday_first(F.col("date")))


@query(DAILY + " SELECT CAST(floor(max_temperature / 5) * 5 AS BIGINT) AS bucket, avg(trips) AS mean, count(*) AS n FROM dt JOIN daily_weather USING (date) GROUP BY 1 HAVING count(*) >= 3", "trips", "daily_weather")
def temperature_buckets(spark: SparkSession, d: str) -> DataFrame:
    days = trips.with_daily_weather(trips.daily_trips(bridge.trips(spark, d)), bridge.daily_weather(spark, d))
    return trips.mean_by(days, (F.floor(F.col("max_temperature") / 5) * 5).cast("long"), least=3)


SPEED = "sp AS (SELECT *, l_quantity / (abs(date_diff('day', CAST(start_time AS DATE), CAST(stop_time AS DATE))) + 1) AS mph FROM trips)"


@query(
    SPEED + """, b AS (SELECT *, CASE WHEN l_quantity < 5 THEN '[0,5)' WHEN l_quantity < 15 THEN '[5,15)' WHEN l_quantity < 40 THEN '[15,40)' END AS bin FROM sp WHERE mph > 0.05 AND mph < 35)
SELECT gender, bin, round(avg(mph), 8) AS mean, median(mph) AS median, round(stddev_samp(mph), 8) AS sd, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""",
    "trips",
)
def speed_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = trips.speed_summary(bridge.trips(spark, d), [0, 5, 15, 40])
    return rows.withColumns({"mean": F.round("mean", 8), "sd": F.round("sd", 8)})


@query(SPEED + ", q AS (SELECT unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]::DOUBLE[]) AS p, unnest(quantile_cont(mph, [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])) AS value FROM sp) SELECT p, round(value, 9) AS value FROM q", "trips")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return trips.quantiles(trips.trip_speeds(bridge.trips(spark, d)), "mph").withColumn("value", F.round("value", 9))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Trips with ids and years in the spellings that raw files have."""
    key = F.col("l_orderkey")
    raw_id = lambda c: F.when(key % 11 == 0, F.lit(None)).when(key % 3 == 0, F.concat(c.cast("string"), F.lit(".0"))).when(key % 3 == 1, F.concat(c.cast("string"), F.lit(".00"))).otherwise(F.concat(c.cast("string"), F.lit(".1")))
    year = F.when(key % 5 == 0, "").when(key % 5 == 1, "NULL").when(key % 5 == 2, F.concat(F.col("birth_year").cast("string"), F.lit(".0"))).otherwise(F.col("birth_year").cast("string"))
    late = F.when(key % 2 == 0, F.lit("2021-03-01").cast("timestamp_ntz")).otherwise(F.lit("2020-03-01").cast("timestamp_ntz"))
    rows = bridge.trips(spark, d)
    place = {f"{e}_station_{x}": F.when(key % 4 == 0, 0.0).otherwise((key % 50) / 10) for e in ("start", "end") for x in ("latitude", "longitude")}
    return rows.select(late.alias("start_time"), raw_id(F.col("start_station_id")).alias("start_station_id"), F.col("end_station_id").cast("string").alias("end_station_id"),
        F.concat(F.lit("N"), F.col("start_station_id").cast("string")).alias("start_station_name"), F.lit("x").alias("end_station_name"),
        year.alias("birth_year"), F.col("gender").cast("string").alias("gender"), "l_orderkey", "l_linenumber", "l_partkey", *[v.alias(k) for k, v in place.items()])


RAW_ID = "CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN start_station_id || '.0' WHEN l_orderkey % 3 = 1 THEN start_station_id || '.00' ELSE start_station_id || '.1' END"
RAW = f"""raw AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN TIMESTAMP '2021-03-01' ELSE TIMESTAMP '2020-03-01' END AS st, {RAW_ID} AS sid, end_station_id, start_station_id AS sn,
  CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'NULL' WHEN 2 THEN birth_year || '.0' ELSE CAST(birth_year AS VARCHAR) END AS byr, l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_orderkey % 4 = 0 THEN 0.0 ELSE (l_orderkey % 50) / 10 END AS lat FROM trips)"""
CLEAN_ID = "CASE WHEN st >= TIMESTAMP '2021-02-01' THEN regexp_replace(sid, '^(\\d+\\.\\d)$', '\\1' || '0') ELSE regexp_replace(sid, '\\.00?$', '') END"
CLEAN_YEAR = "CAST(CAST(nullif(nullif(byr, ''), 'NULL') AS DECIMAL(20, 6)) AS INT)"


@query(RAW + f" SELECT l_orderkey, l_linenumber, l_partkey, {CLEAN_ID} AS start_station_id, {CLEAN_YEAR} AS birth_year, nullif(lat, 0) AS start_latitude FROM raw WHERE sid IS NOT NULL AND end_station_id IS NOT NULL", "trips")
def trips_split(spark: SparkSession, d: str) -> DataFrame:
    return trips.split_raw(_raw(spark, d))[0].select("l_orderkey", "l_linenumber", "l_partkey", "start_station_id", "birth_year", "start_latitude")


@query(RAW + f" SELECT l_orderkey, l_linenumber, l_partkey, {CLEAN_YEAR} AS birth_year, lat AS start_latitude FROM raw WHERE sid IS NULL OR end_station_id IS NULL", "trips")
def trips_dockless(spark: SparkSession, d: str) -> DataFrame:
    return trips.split_raw(_raw(spark, d))[1].select("l_orderkey", "l_linenumber", "l_partkey", "birth_year", "start_latitude")


@query(RAW + f" SELECT DISTINCT sid AS raw_id, st AS start_time, {CLEAN_ID} AS id FROM raw", "trips")
def normalize_station_id(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw(spark, d).select(F.col("start_station_id").alias("raw_id"), "start_time").distinct()
    return rows.withColumn("id", station_id(F.col("raw_id"), F.col("start_time")))


@query(RAW + f" SELECT DISTINCT byr AS raw_year, {CLEAN_YEAR} AS birth_year FROM raw", "trips")
def nullif_clean(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select(F.col("birth_year").alias("raw_year")).distinct().withColumn("birth_year", clean_int(F.col("raw_year")))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    t = _raw(spark, d).where("start_station_id is not null")
    return t.select(F.concat(F.lit("s"), (F.col("l_orderkey") % 40).cast("string")).alias("station_id"), F.col("start_station_name").alias("name"), F.col("start_station_latitude").alias("latitude"), (F.col("l_orderkey") % 7 / 3).alias("longitude"))


DISTINCT_ON = (
    RAW
    + """, en AS (SELECT DISTINCT 's' || (l_orderkey % 40) AS id, 'N' || sn AS name, lat, (l_orderkey % 7) / 3 AS lon FROM raw WHERE sid IS NOT NULL),
nw AS (SELECT DISTINCT ON (id) id AS normalized_id, name, round(lat, 4) AS latitude, round(lon, 4) AS longitude, 'trips_data' AS data_source
  FROM en WHERE id NOT IN ('s1', 's2') GROUP BY id, name, round(lat, 4), round(lon, 4) ORDER BY id, count(*) DESC, name, latitude, longitude)"""
)


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s1", "one", 1.0, 1.0, "site"), ("s2", "two", 2.0, 2.0, "site")], "normalized_id string, name string, latitude double, longitude double, data_source string")


@query(DISTINCT_ON + " SELECT * FROM nw", "trips")
def station_dedup_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return trips.stations_from_trips(_ends(spark, d), _known(spark))


@query(DISTINCT_ON + ", old AS (SELECT * FROM (VALUES ('s1', 'one', 1.0, 1.0, 'site'), ('s3', 'three', 3.0, 3.0, 'site'), ('zz', 'last', 9.0, 9.0, 'site')) t(normalized_id, name, latitude, longitude, data_source)) SELECT * FROM old WHERE normalized_id NOT IN (SELECT normalized_id FROM nw) UNION ALL SELECT * FROM nw", "trips")
def station_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([("s1", "one", 1.0, 1.0, "site"), ("s3", "three", 3.0, 3.0, "site"), ("zz", "last", 9.0, 9.0, "site")], "normalized_id string, name string, latitude double, longitude double, data_source string")
    return upsert(old, trips.stations_from_trips(_ends(spark, d), _known(spark)), "normalized_id")


@query("SELECT station_id, CASE WHEN n_name IS NULL THEN name ELSE 'in ' || n_name END AS name FROM stations LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey < 3) ON s_suppkey = station_id WHERE NOT station_id % 10 = 0", "stations")
def station_update_delete(spark: SparkSession, d: str) -> DataFrame:
    stations = bridge.stations(spark, d).select("station_id", "name")
    nation = bridge.read(spark, d, "nation").where("n_regionkey < 3")
    fresh = bridge.read(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("station_id"), F.concat(F.lit("in "), "n_name").alias("name"))
    return delete_where(update_from(stations, fresh, "station_id", ["name"]), F.col("station_id") % 10 == 0)


@query(SPEED + " SELECT round(regr_intercept(mph, l_quantity), 6) AS intercept, round(regr_slope(mph, l_quantity), 6) AS slope FROM sp", "trips")
def ols_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = models.ols(trips.trip_speeds(bridge.trips(spark, d)), "mph", {"miles": F.col("miles")})
    return spark.createDataFrame([(round(fit["intercept"], 6), round(fit["miles"], 6))], "intercept double, slope double")


@query(
    SPEED + """, f AS (SELECT regr_intercept(mph, l_quantity) AS a, regr_slope(mph, l_quantity) AS b FROM sp)
SELECT gender, round(avg(mph - a - b * l_quantity), 6) AS error, round(sqrt(avg(pow(mph - a - b * l_quantity, 2))), 6) AS rmse FROM sp, f GROUP BY 1""",
    "trips",
)
def ols_errors(spark: SparkSession, d: str) -> DataFrame:
    rows, features = trips.trip_speeds(bridge.trips(spark, d)), {"miles": F.col("miles")}
    done = models.predict(rows, "mph", features, models.ols(rows, "mph", features))
    return done.groupBy("gender").agg(F.round(F.avg("residual"), 6).alias("error"), F.round(F.sqrt(F.avg(F.pow("residual", F.lit(2)))), 6).alias("rmse"))


@query(DAILY + " SELECT date, kind, CAST(value AS DOUBLE) AS value FROM (SELECT date, CAST(trips AS DOUBLE) AS actual, CAST(trips AS DOUBLE) / 2 AS predicted FROM dt) UNPIVOT (value FOR kind IN (actual, predicted))", "trips")
def unpivot_actual_predicted(spark: SparkSession, d: str) -> DataFrame:
    daily = trips.daily_trips(bridge.trips(spark, d)).select("date", F.col("trips").cast("double").alias("actual"), (F.col("trips") / 2).alias("predicted"))
    return daily.unpivot(["date"], ["actual", "predicted"], "kind", "value")


@query(
    """SELECT station_id, name FROM stations WHERE station_id IN (SELECT start_station_id FROM trips WHERE gender = 1 AND start_time >= TIMESTAMP '1998-06-01')
  OR station_id IN (SELECT end_station_id FROM trips WHERE gender = 2 AND start_time < TIMESTAMP '1992-06-01')""",
    "trips", "stations",
)
def stations_at_either_end(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.trips(spark, d)
    starts, ends = rows.where("gender = 1 and start_time >= timestamp_ntz'1998-06-01'"), rows.where("gender = 2 and start_time < timestamp_ntz'1992-06-01'")
    return trips.seen_at_either_end(bridge.stations(spark, d).select("station_id", "name"), starts, ends)


#: A fixed value: the example of the polyline format and the points that it stands for.
POLYLINE, POLYLINE_POINTS = "_p~iF~ps|U_ulLnnqC_mqNvxq`@", ((-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252))
_LEG_ROWS = ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, (a, b) in enumerate(zip(POLYLINE_POINTS, POLYLINE_POINTS[1:])))


@query(f"SELECT n_nationkey, number, start_lon, start_lat, end_lon, end_lat FROM nation, (VALUES {_LEG_ROWS}) t(number, start_lon, start_lat, end_lon, end_lat)")
def polyline_legs(spark: SparkSession, d: str) -> DataFrame:
    path = bridge.read(spark, d, "nation").select("n_nationkey", F.posexplode(decode_polyline(F.lit(POLYLINE))).alias("position", "q"))
    return trips.legs_of(path.select("n_nationkey", "position", "q.*"), "n_nationkey", "position").select("n_nationkey", F.col("number"), "start_lon", "start_lat", "end_lon", "end_lat")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7919 % 36000000 - 18000000) / 100000.0::DOUBLE AS lon, (l_suppkey * 104729 % 18000000 - 9000000) / 100000.0::DOUBLE AS lat FROM lineitem),
n AS (SELECT l_orderkey, CAST(row_number() OVER w - 1 AS INT) AS number, lon AS start_lon, lat AS start_lat, lead(lon) OVER w AS end_lon, lead(lat) OVER w AS end_lat FROM p
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, lon, lat))
SELECT * FROM n WHERE end_lon IS NOT NULL"""
)
def route_legs(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as points of a route, written as a polyline; the legs come from the text."""
    lon, lat = (F.col("l_partkey") * 7919 % 36_000_000 - 18_000_000) / 100_000, (F.col("l_suppkey") * 104_729 % 18_000_000 - 9_000_000) / 100_000
    stops = bridge.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", lon.alias("lon"), lat.alias("lat")))).alias("stops"))
    route = F.transform("stops", lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))
    paths = stops.select("l_orderkey", encode_polyline(route).alias("line")).select("l_orderkey", decode_polyline(F.col("line")).alias("path"))
    return trips.legs_of_paths(paths, "l_orderkey", "path")


@query(
    """WITH t AS (SELECT c_custkey, c_custkey / 3.0::DOUBLE AS x, c_custkey / 3.0::DOUBLE + c_custkey % 4 * 0.000004::DOUBLE AS y FROM customer)
SELECT c_custkey, CAST(CASE WHEN round(x, 5) = round(y, 5) THEN 2 ELSE 3 END AS INT) AS n_points, round(x, 5) AS lon, round(y, 5) AS second_lon FROM t"""
)
def rounded_ring(spark: SparkSession, d: str) -> DataFrame:
    """The second point is up to 0.000012 degrees from the first, so that rounding joins some of them."""
    key = F.col("c_custkey").cast("double")
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    aside = key / 3 + F.col("c_custkey") % 4 * F.lit(0.000004)
    ring = F.array(point(key / 3, key / 7), point(aside, key / 7), point(key + 1, key + 1))
    rings = bridge.read(spark, d, "customer").select("c_custkey", rounded_rings(F.array(F.array(ring))).alias("r"))
    first = F.col("r")[0][0]
    return rings.select("c_custkey", F.size(first).alias("n_points"), first[0]["lon"].alias("lon"), F.when(F.size(first) == 3, first[1]["lon"]).otherwise(first[0]["lon"]).alias("second_lon"))


@query(
    """WITH m AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1),
t AS (SELECT *, pow(10, floor(log10(top / 5))) AS p FROM m),
s AS (SELECT *, p * CASE WHEN top / 5 / p <= 1 THEN 1 WHEN top / 5 / p <= 2 THEN 2 WHEN top / 5 / p <= 5 THEN 5 ELSE 10 END AS step FROM t)
SELECT o_custkey, CAST(ceil(top / step - 1e-9) AS INT) + 1 AS n_ticks, round(ceil(top / step - 1e-9) * step, 6) AS last FROM s"""
)
def axis_tick_rows(spark: SparkSession, d: str) -> DataFrame:
    """An axis for each customer, up to the dearest order."""
    tops = bridge.read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return tops.select("o_custkey", axis_ticks(F.col("top")).alias("t")).select("o_custkey", F.size("t").alias("n_ticks"), F.round(F.element_at("t", -1), 6).alias("last"))


@query("SELECT l_orderkey, round_even(sum(l_quantity) / 4.0::DOUBLE, 1) AS tenth, round_even(sum(l_quantity) / 2.0::DOUBLE, 0) AS whole FROM lineitem GROUP BY 1")
def half_even_rounding(spark: SparkSession, d: str) -> DataFrame:
    sums = bridge.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n"))
    return sums.select("l_orderkey", half_even(F.col("n") / 4, 1).alias("tenth"), half_even(F.col("n") / 2).alias("whole"))
