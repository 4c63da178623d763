"""Queries over the availability relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.localtime import epoch, hour_of, local, seconds_between
from ..functions.values import ellipsis, left_closed, relabel, s_curve, slug, step_bin
from ..operators.asof import asof_left, asof_or_earliest
from ..operators.intervals import holes, islands, without_overlap
from ..operators.scan import neighbours
from ..sources import bridge
from ..sources.bridge import with_views
from . import metrics
from .coverage import MetricResult, full_days

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def _local(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin')"


def _utc(day: str) -> str:
    return f"((CAST({day} AS TIMESTAMP) AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC')"


def _days(table: str = "status") -> str:
    return f"""
loc AS (SELECT DISTINCT snapshot_ts, {_local('snapshot_ts')} AS l, CAST({_local('snapshot_ts')} AS DATE) AS d FROM {table}),
cov AS (SELECT d, bool_or(l < d + INTERVAL 1 HOUR) AS a, bool_or(l >= d + INTERVAL 23 HOUR) AS z FROM loc GROUP BY d),
lost AS (SELECT d, sum(greatest(0, date_diff('second', greatest(gap_start, {_utc('d')}), least(gap_end, {_utc('d + INTERVAL 1 DAY')})))) AS s
  FROM cov JOIN gaps ON gap_start < {_utc('d + INTERVAL 1 DAY')} AND gap_end > {_utc('d')} GROUP BY d),
full_days AS (SELECT d AS local_date FROM cov LEFT JOIN lost USING (d) WHERE a AND z AND coalesce(s, 0) < 3600)"""


WD, HR = "CAST(isodow({0}) - 1 AS INT)", "CAST(hour({0}) AS INT)"
L = _local("snapshot_ts")
WDL, HRL = WD.format(L), HR.format(L)


@query(_days() + " SELECT local_date FROM full_days", "status", "gaps")
def full_days_rows(spark: SparkSession, d: str) -> DataFrame:
    return full_days(bridge.catalog(spark, d))


@query(
    f"""t AS (SELECT snapshot_ts, sum(num_bikes_available) AS b FROM status_grid GROUP BY 1)
SELECT {WDL} AS weekday, {HRL} AS local_hour, avg(b) AS mean_bikes_available, count(*) AS n_snapshots FROM t GROUP BY 1, 2""",
    "status_grid",
)
def availability_city(spark: SparkSession, d: str) -> DataFrame:
    return metrics.availability_rows(bridge.catalog(spark, d, grid=True))


@query(
    f"""t AS (SELECT snapshot_ts, bezirk, sum(num_bikes_available) AS b FROM status_grid JOIN areas USING (source, station_id) GROUP BY 1, 2)
SELECT {WDL} AS weekday, {HRL} AS local_hour, bezirk, avg(b) AS mean_bikes_available, count(*) AS n_snapshots FROM t GROUP BY 1, 2, 3""",
    "status_grid", "areas",
)
def availability_bezirk(spark: SparkSession, d: str) -> DataFrame:
    return metrics.availability_rows(bridge.catalog(spark, d, grid=True), "bezirk")


def _published(result: MetricResult, rows: DataFrame) -> DataFrame:
    """What a metric shows, with the number of full days: no rows below the minimum."""
    shown = rows.where(F.lit(False)) if result.rows is None else result.rows
    return shown.withColumn("n_full_days", F.lit(result.full_days).cast("long"))


ENOUGH = "(SELECT count(*) FROM full_days) AS n_full_days"


@query(
    _days("status_grid")
    + f""", t AS (SELECT snapshot_ts, bezirk, sum(num_bikes_available) AS b FROM status_grid JOIN areas USING (source, station_id) GROUP BY 1, 2)
SELECT {WDL} AS weekday, {HRL} AS local_hour, bezirk, avg(b) AS mean_bikes_available, count(*) AS n_snapshots, {ENOUGH} FROM t GROUP BY 1, 2, 3 HAVING n_full_days >= 14""",
    "status_grid", "gaps", "areas",
)
def availability_published(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d, grid=True)
    return _published(metrics.availability_by_hour(c, "bezirk"), metrics.availability_rows(c, "bezirk"))


def _empty(window: str = "true") -> str:
    return (
        _days()
        + f""",
iv AS (SELECT *, lead(snapshot_ts) OVER (PARTITION BY source, station_id ORDER BY snapshot_ts) AS nx FROM status),
med AS (SELECT median(date_diff('second', snapshot_ts, nx)) AS m FROM iv WHERE nx IS NOT NULL),
es AS (SELECT source, station_id, sum(date_diff('second', snapshot_ts, nx)) AS s FROM iv, med
  WHERE nx IS NOT NULL AND num_bikes_available = 0 AND is_installed AND date_diff('second', snapshot_ts, nx) <= 2 * m
    AND CAST({L} AS DATE) IN (SELECT local_date FROM full_days) AND ({window})
    AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.source = iv.source AND g.gap_start < nx AND g.gap_end > snapshot_ts)
  GROUP BY 1, 2)"""
    )


MINUTES = "s / 60.0::DOUBLE AS empty_minutes_total, s / 60.0::DOUBLE / (SELECT count(*) FROM full_days) AS empty_minutes_per_day"
MORNING_SQL = f"isodow({L}) <= 5 AND CAST({L} AS TIME) >= TIME '07:30' AND CAST({L} AS TIME) < TIME '08:30'"


@query(_empty() + f" SELECT station_id, bezirk, ortsteil, {MINUTES} FROM es JOIN areas USING (source, station_id) WHERE s > 0", "status", "gaps", "areas")
def empty_minutes_station(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    return metrics.empty_station_rows(c, full_days(c))


@query(
    _empty() + f", o AS (SELECT ortsteil, bezirk, sum(s) AS s FROM es JOIN areas USING (source, station_id) GROUP BY 1, 2) SELECT ortsteil, bezirk, {MINUTES} FROM o WHERE s > 0",
    "status", "gaps", "areas",
)
def empty_minutes_ortsteil(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    return metrics.empty_ortsteil_rows(c, full_days(c))


@query(_empty(MORNING_SQL) + f" SELECT station_id, bezirk, ortsteil, {MINUTES} FROM es JOIN areas USING (source, station_id) WHERE s > 0", "status", "gaps", "areas")
def empty_minutes_morning_window(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    return metrics.empty_station_rows(c, full_days(c), metrics.MORNING)


@query(_empty() + f" SELECT station_id, {MINUTES} FROM es JOIN areas USING (source, station_id) WHERE s > 0 ORDER BY s DESC, station_id LIMIT 10", "status", "gaps", "areas")
def top10_shortage(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    rows = metrics.empty_station_rows(c, full_days(c)).select("station_id", "empty_minutes_total", "empty_minutes_per_day")
    return rows.orderBy(F.desc("empty_minutes_total"), "station_id").limit(10)


@query(
    _days("status_grid")
    + f""",
c AS (SELECT *, CAST({L} AS DATE) AS d FROM status_grid WHERE isodow({L}) <= 5 AND CAST({L} AS TIME) BETWEEN TIME '07:50' AND TIME '08:00'
  AND CAST({L} AS DATE) IN (SELECT local_date FROM full_days)),
p AS (SELECT snapshot_ts, count(*) FILTER (is_installed) AS i, count(*) FILTER (is_installed AND num_bikes_available = 0) AS e
  FROM c WHERE (d, snapshot_ts) IN (SELECT (d, max(snapshot_ts)) FROM c GROUP BY d) GROUP BY 1)
SELECT avg(CAST(e AS DOUBLE) / i) AS share_empty_at_0800 FROM p WHERE i > 0""",
    "status_grid", "gaps",
)
def share_empty_0800(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d, grid=True)
    return metrics.share_empty_rows(c, full_days(c))


NET = (
    _days()
    + f""",
lg AS (SELECT *, lag(snapshot_ts) OVER w AS p, num_bikes_available - lag(num_bikes_available) OVER w AS delta FROM status
  WINDOW w AS (PARTITION BY source, station_id ORDER BY snapshot_ts)),
med AS (SELECT median(date_diff('second', p, snapshot_ts)) AS m FROM lg WHERE p IS NOT NULL),
dl AS (SELECT lg.*, bezirk, CASE WHEN isodow({L}) <= 5 THEN 'weekday' ELSE 'weekend' END AS day_type, {HRL} AS local_hour
  FROM lg JOIN areas USING (source, station_id), med
  WHERE p IS NOT NULL AND delta <> 0 AND date_diff('second', p, snapshot_ts) <= 2 * m
    AND CAST({L} AS DATE) IN (SELECT local_date FROM full_days)
    AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.source = lg.source AND g.gap_start < snapshot_ts AND g.gap_end > p)),
nd AS (SELECT CASE WHEN isodow(local_date) <= 5 THEN 'weekday' ELSE 'weekend' END AS day_type, count(*) AS n FROM full_days GROUP BY 1),
net AS (SELECT day_type, local_hour, bezirk, CAST(sum(greatest(delta, 0)) AS DOUBLE) / any_value(n) AS gains_per_day,
  CAST(sum(greatest(-delta, 0)) AS DOUBLE) / any_value(n) AS losses_per_day, CAST(sum(delta) AS DOUBLE) / any_value(n) AS net_per_day
  FROM dl JOIN nd USING (day_type) GROUP BY 1, 2, 3)"""
)


@query(NET + " SELECT * FROM net", "status", "gaps", "areas")
def net_flow_bezirk(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    return metrics.net_flow_rows(c, full_days(c))


@query(
    NET
    + """ SELECT l.day_type, l.local_hour, l.bezirk AS from_bezirk, g.bezirk AS to_bezirk, round(-l.net_per_day * g.net_per_day / t.s, 9) AS bikes_per_day
FROM net l JOIN net g USING (day_type, local_hour) JOIN (SELECT day_type, local_hour, sum(net_per_day) AS s FROM net WHERE net_per_day > 0 GROUP BY 1, 2) t USING (day_type, local_hour)
WHERE l.net_per_day < 0 AND g.net_per_day > 0""",
    "status", "gaps", "areas",
)
def flow_between(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    return metrics.flow_between_rows(metrics.net_flow_rows(c, full_days(c))).withColumn("bikes_per_day", F.round("bikes_per_day", 9))


@query(NET + f" SELECT net.*, {ENOUGH} FROM net WHERE n_full_days >= 14", "status", "gaps", "areas")
def net_flow_published(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    return _published(metrics.net_flow_by_bezirk(c), metrics.net_flow_rows(c, full_days(c)))


@query(
    NET
    + """, h AS (SELECT unnest(range(24)) AS local_hour), k AS (SELECT DISTINCT day_type, bezirk FROM net)
SELECT k.day_type, k.bezirk, CAST(h.local_hour AS INT) AS local_hour, coalesce(net_per_day, 0) AS net_per_day
FROM k CROSS JOIN h LEFT JOIN net ON net.day_type = k.day_type AND net.bezirk = k.bezirk AND net.local_hour = h.local_hour""",
    "status", "gaps", "areas",
)
def densified_flow(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    net = metrics.net_flow_rows(c, full_days(c))
    grid = net.select("day_type", "bezirk").distinct().withColumn("local_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(net, ["day_type", "bezirk", "local_hour"], "left").select("day_type", "bezirk", "local_hour", F.coalesce("net_per_day", F.lit(0.0)).alias("net_per_day"))


PROPULSION = "CASE WHEN propulsion_type = 'human' THEN 'pedal' WHEN propulsion_type IN ('electric_assist', 'electric') THEN 'ebike' ELSE 'unknown' END"


@query(
    _days("status_grid")
    + f""",
st AS (SELECT snapshot_ts, sum(num_bikes_available) AS b FROM status_grid GROUP BY 1),
ff AS (SELECT snapshot_ts, sum(num_bikes) AS b FROM free_cells WHERE NOT at_station GROUP BY 1),
ev AS (SELECT vehicle_type_id, arg_min(propulsion_type, snapshot_ts) AS k FROM vehicle_types GROUP BY 1),
rs AS (SELECT e.snapshot_ts, e.num_bikes, coalesce(v.propulsion_type, ev.k) AS propulsion_type FROM (SELECT * FROM free_cells WHERE NOT at_station) e
  ASOF LEFT JOIN vehicle_types v ON v.vehicle_type_id = e.vehicle_type_id AND e.snapshot_ts >= v.snapshot_ts LEFT JOIN ev ON ev.vehicle_type_id = e.vehicle_type_id),
tt AS (SELECT snapshot_ts, sum(num_bikes) FILTER (k = 'ebike') AS e, sum(num_bikes) FILTER (k = 'pedal') AS p, sum(num_bikes) FILTER (k = 'unknown') AS u
  FROM (SELECT *, {PROPULSION} AS k FROM rs) GROUP BY 1),
ds AS (SELECT CAST({L} AS DATE) AS local_date, count(DISTINCT station_id) AS n_stations FROM status_grid GROUP BY 1)
SELECT local_date, n_stations, avg(coalesce(st.b, 0)) AS mean_bikes_at_stations, avg(coalesce(ff.b, 0)) AS mean_bikes_free_floating,
  avg(coalesce(e, 0)) AS mean_ebikes, avg(coalesce(p, 0)) AS mean_pedal_bikes, avg(coalesce(u, 0)) AS mean_unknown_type
FROM st LEFT JOIN ff USING (snapshot_ts) LEFT JOIN tt USING (snapshot_ts) JOIN ds ON ds.local_date = CAST({_local('st.snapshot_ts')} AS DATE)
WHERE local_date IN (SELECT local_date FROM full_days) GROUP BY 1, 2""",
    "status_grid", "gaps", "free_cells", "vehicle_types",
)
def footprint_daily(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d, grid=True)
    return metrics.footprint_rows(c, full_days(c))


@query(f"SELECT * FROM ({ORACLES['footprint_daily']}) ORDER BY local_date DESC LIMIT 1")
def footprint_latest_day(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d, grid=True)
    return metrics.latest(metrics.footprint_rows(c, full_days(c)))


@query(
    """docked AS (SELECT unnest([station_id % 20, 20 + station_id % 3]) AS vehicle_type_id, unnest([num_bikes_available, 1]) AS bikes FROM status WHERE event_id % 3 <> 0)
SELECT vehicle_type_id, CAST(sum(bikes) AS BIGINT) AS bikes, count(*) AS n FROM (
  SELECT * FROM docked UNION ALL SELECT vehicle_type_id, num_bikes FROM free_cells WHERE NOT at_station) GROUP BY 1""",
    "status", "free_cells",
)
def bikes_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Stations list their bikes by type in some snapshots and lack the list, or have an empty one, in others."""
    counted = lambda kind, n: F.struct(kind.alias("vehicle_type_id"), n.alias("count"))
    station = F.col("station_id")
    listed = F.array(counted(station % 20, F.col("num_bikes_available")), counted(20 + station % 3, F.lit(1)))
    empty = F.when(F.col("event_id") % 2 == 0, F.slice(listed, 1, 0))
    rows = bridge.status(spark, d).withColumn("vehicle_types_available", F.when(F.col("event_id") % 3 != 0, listed).otherwise(empty))
    entries = metrics.typed_entries(bridge.Catalog(spark, tables={"station_status": rows, "free_bike_cells": bridge.free_bike_cells(spark, d)}))
    return entries.groupBy("vehicle_type_id").agg(F.sum("bikes").alias("bikes"), F.count("*").alias("n"))


@query(
    """SELECT e.event_id, e.ts, v.propulsion_type FROM events e
ASOF LEFT JOIN vehicle_types v ON v.vehicle_type_id = e.user_id % 25 AND e.ts >= v.snapshot_ts""",
    "vehicle_types",
)
def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    left = bridge.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % 25).alias("vehicle_type_id"))
    return asof_left(left, bridge.vehicle_types(spark, d), ["vehicle_type_id"], "ts", "snapshot_ts", ["propulsion_type"]).drop("vehicle_type_id")


@query(
    """ev AS (SELECT vehicle_type_id, arg_min(propulsion_type, snapshot_ts) AS k FROM vehicle_types GROUP BY 1)
SELECT e.event_id, coalesce(v.propulsion_type, k) AS propulsion_type FROM events e
ASOF LEFT JOIN vehicle_types v ON v.vehicle_type_id = e.user_id % 25 AND e.ts >= v.snapshot_ts LEFT JOIN ev ON ev.vehicle_type_id = e.user_id % 25""",
    "vehicle_types",
)
def asof_fallback(spark: SparkSession, d: str) -> DataFrame:
    left = bridge.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % 25).alias("vehicle_type_id"))
    return asof_or_earliest(left, bridge.vehicle_types(spark, d), ["vehicle_type_id"], "ts", "snapshot_ts", "propulsion_type").select("event_id", "propulsion_type")


PROFILE = (
    _days()
    + f""",
li AS (SELECT station_id, arg_max(name, snapshot_ts) AS name, arg_max(lat, snapshot_ts) AS lat, arg_max(lon, snapshot_ts) AS lon FROM info GROUP BY 1),
pr AS (SELECT station_id, name, lat, lon, ortsteil, {WDL} AS weekday, {HRL} AS local_hour, avg(num_bikes_available) AS mean_bikes_available, count(*) AS n_snapshots
  FROM status JOIN li USING (station_id) LEFT JOIN areas USING (station_id) WHERE CAST({L} AS DATE) IN (SELECT local_date FROM full_days) GROUP BY ALL)"""
)


@query(PROFILE + " SELECT * FROM pr", "status", "gaps", "areas", "info")
def station_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    return metrics.station_profile_rows(c, full_days(c))


@query(
    _days("status_grid")
    + f""",
t AS (SELECT ortsteil, snapshot_ts, sum(num_bikes_available) AS b FROM status_grid JOIN areas USING (source, station_id)
  WHERE CAST({L} AS DATE) IN (SELECT local_date FROM full_days) GROUP BY 1, 2)
SELECT ortsteil, {WDL} AS weekday, {HRL} AS local_hour, avg(b) AS mean_bikes_available, count(*) AS n_snapshots FROM t GROUP BY 1, 2, 3""",
    "status_grid", "gaps", "areas",
)
def ortsteil_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d, grid=True)
    return metrics.ortsteil_profile_rows(c, full_days(c))


@query(
    PROFILE
    + """, g AS (SELECT station_id, w, h FROM (SELECT DISTINCT station_id FROM pr), (SELECT unnest(range(7)) AS w), (SELECT unnest(range(24)) AS h))
SELECT g.station_id, array_to_string(list(coalesce(CAST(CAST(floor(mean_bikes_available * 10 + 0.5) AS INT) AS VARCHAR), '-') ORDER BY w, h), ' ') AS curve
FROM g LEFT JOIN pr ON pr.station_id = g.station_id AND weekday = w AND local_hour = h GROUP BY 1""",
    "status", "gaps", "areas", "info",
)
def profile_curve_nested(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d)
    rows = metrics.station_profile_rows(c, full_days(c)).withColumn("mean_bikes_available", F.floor(F.col("mean_bikes_available") * 10 + 0.5))
    curves = metrics.profile_curves(rows, "station_id", 0)
    text = F.array_join(F.transform(F.flatten("curves"), lambda x: x.cast("int").cast("string")), " ", "-")
    return curves.select("station_id", text.alias("curve"))


@query(
    f"""SELECT station_id, snapshot_ts, {L} AS local_ts, precipitation_mm, temperature_c, hour_ts IS NULL AS weather_missing
FROM status_grid LEFT JOIN weather ON hour_ts = date_trunc('hour', snapshot_ts)""",
    "status_grid", "weather",
)
def snapshot_weather(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.snapshot_weather(bridge.catalog(spark, d, grid=True))
    return rows.select("station_id", "snapshot_ts", "local_ts", "precipitation_mm", "temperature_c", "weather_missing")


def _weather(column: str, test: str, yes: str, no: str) -> str:
    return f"""sw AS (SELECT s.*, w.*, {L} AS l, hour_ts IS NULL AS miss FROM status_grid s LEFT JOIN weather w ON hour_ts = date_trunc('hour', snapshot_ts)),
ps AS (SELECT snapshot_ts, l, max({column}) AS v, bool_or(miss) AS miss, sum(num_bikes_available) AS b, count(*) FILTER (is_installed) AS i,
  count(*) FILTER (is_installed AND num_bikes_available = 0) AS e FROM sw GROUP BY 1, 2),
cl AS (SELECT *, CASE WHEN miss OR v IS NULL THEN 'excluded' WHEN v {test} THEN '{yes}' ELSE '{no}' END AS bucket FROM ps)
SELECT bucket, CASE WHEN bucket <> 'excluded' THEN CAST(hour(l) AS INT) END AS local_hour, CASE WHEN bucket <> 'excluded' THEN avg(b) END AS mean_bikes_available,
  CASE WHEN bucket <> 'excluded' THEN round(avg(CAST(e AS DOUBLE) / nullif(i, 0)), 9) END AS empty_station_share, count(*) AS n_snapshots, count(DISTINCT date_trunc('hour', snapshot_ts)) AS n_hours
FROM cl GROUP BY 1, 2"""


@query(_weather("precipitation_mm", ">= 0.1", "rainy", "dry"), "status_grid", "weather")
def weather_effect_rain(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weather_rows(bridge.catalog(spark, d, grid=True), "rain").withColumn("empty_station_share", F.round("empty_station_share", 9))


@query(
    _days("status_grid") + ", shown AS (WITH " + _weather("temperature_c", "< 10.0", "cold", "warm") + f") SELECT *, {ENOUGH} FROM shown WHERE n_full_days >= 14",
    "status_grid", "gaps", "weather",
)
def weather_effect_published(spark: SparkSession, d: str) -> DataFrame:
    c = bridge.catalog(spark, d, grid=True)
    shown = _published(metrics.weather_effect(c, "temperature"), metrics.weather_rows(c, "temperature"))
    return shown.withColumn("empty_station_share", F.round("empty_station_share", 9))


@query(_weather("temperature_c", "< 10.0", "cold", "warm"), "status_grid", "weather")
def weather_effect_temp(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weather_rows(bridge.catalog(spark, d, grid=True), "temperature").withColumn("empty_station_share", F.round("empty_station_share", 9))


@query(
    """e AS (SELECT *, date_trunc('day', ts) AS payload FROM events WHERE event_type = 'click'),
f AS (SELECT *, row_number() OVER (PARTITION BY payload, CASE WHEN user_id % 10 <> 0 THEN user_id END ORDER BY event_id) AS rn FROM e)
SELECT payload AS snapshot_ts, user_id % 50 AS cell, event_id % 3 = 0 AS at_station, count(*) AS num_bikes, count(*) FILTER (value > 100) AS num_disabled
FROM f WHERE rn = 1 OR user_id % 10 = 0 GROUP BY 1, 2, 3"""
    .replace("e AS", "WITH e AS", 1)
)
def free_bike_cells_agg(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.feeds import cells_of

    rows = bridge.read(spark, d, "events").where("event_type = 'click'")
    bikes = rows.select(
        F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("snapshot_ts"),
        F.col("event_id").alias("position"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("bike_id"),
        (F.col("user_id") % 50).alias("cell"),
        (F.col("event_id") % 3 == 0).alias("at_station"),
        (F.col("value") > 100).alias("is_disabled"),
        F.lit(False).alias("is_reserved"),
    )
    return cells_of(bikes, ["snapshot_ts"], ["cell", "at_station"]).drop("num_reserved")


@query(
    """g AS (SELECT source, station_id AS key, snapshot_ts AS gap_end, lag(snapshot_ts) OVER (PARTITION BY station_id ORDER BY snapshot_ts) AS gap_start FROM status)
SELECT key AS station_id, gap_start, gap_end FROM g WHERE date_diff('second', gap_start, gap_end) > 172800""",
    "status",
)
def gap_detection_batch(spark: SparkSession, d: str) -> DataFrame:
    return holes(bridge.status(spark, d), "station_id", "snapshot_ts", 172_800)


@query(
    """WITH p AS (SELECT CAST(user_id % 100 AS VARCHAR) AS source, event_type AS feed, ts, coalesce(min(value) > 40, false) AS ok FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT *, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY source, feed ORDER BY ts) AS newest,
  min(CASE WHEN ok THEN ts END) OVER (PARTITION BY source, feed ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back FROM p)
SELECT source, feed, coalesce(newest, min(ts)) AS gap_start, back AS gap_end, 'fetch_error' AS reason, CAST(count(*) AS INTEGER) AS attempts
FROM q WHERE NOT ok AND back IS NOT NULL GROUP BY source, feed, newest, back"""
)
def gaps_of_events(spark: SparkSession, d: str) -> DataFrame:
    """The table of moves over events as polls: those of a low value failed, the others brought a snapshot of their time."""
    from ..streaming.gaps import gaps_of

    ok = F.coalesce(F.min("value") > 40, F.lit(False)).alias("ok")
    keys = [(F.col("user_id") % 100).cast("string").alias("source"), F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("fetched_at")]
    rows = bridge.read(spark, d, "events").groupBy(*keys).agg(ok)
    polls = rows.select("*", F.when(F.col("ok"), F.col("fetched_at")).alias("last_updated"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("timestamp").alias("covered"))
    return gaps_of(polls).select("source", "feed", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("gap_start", "gap_end")], "reason", "attempts")


@query(
    """iv AS (SELECT *, lead(snapshot_ts) OVER (PARTITION BY station_id ORDER BY snapshot_ts) AS nx FROM status)
SELECT station_id, snapshot_ts FROM iv WHERE nx IS NOT NULL AND date_diff('second', snapshot_ts, nx) <= 7200
  AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.source = iv.source AND g.gap_start < nx AND g.gap_end > snapshot_ts)""",
    "status", "gaps",
)
def intervals_without_gaps(spark: SparkSession, d: str) -> DataFrame:
    ahead = F.lead("snapshot_ts").over(Window.partitionBy("station_id").orderBy("snapshot_ts"))
    rows = bridge.status(spark, d).withColumn("next_ts", ahead).where("next_ts is not null").where(seconds_between(F.col("snapshot_ts"), F.col("next_ts")) <= 7200)
    return without_overlap(rows, bridge.gaps(spark, d), "source", "snapshot_ts", "next_ts").select("station_id", "snapshot_ts")


@query(
    """o AS (SELECT source, gap_start, gap_end, max(gap_end) OVER (PARTITION BY source ORDER BY gap_start, gap_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT DISTINCT * FROM gaps)),
n AS (SELECT *, sum(CASE WHEN gap_start < r THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY gap_start, gap_end) AS k FROM o)
SELECT source, min(gap_start) AS gap_start, max(gap_end) AS gap_end FROM n GROUP BY source, k""",
    "gaps",
)
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return islands(bridge.gaps(spark, d), "source")


#: Of the events, nine in ten belong to one key.
HOT = "CASE WHEN user_id % 10 = 0 THEN user_id % 20 ELSE 1 END"


@query(
    f"""l AS (SELECT event_id, ts, {HOT} AS k FROM events),
r AS (SELECT ts, event_id % 1000 AS v, {HOT} AS k FROM events WHERE event_type = 'signup'),
o AS (SELECT k, ts, max(v) AS v FROM r GROUP BY k, ts)
SELECT event_id, o.v AS match FROM l ASOF LEFT JOIN o ON l.k = o.k AND l.ts >= o.ts""".replace("l AS", "WITH l AS", 1)
)
def asof_hot_key(spark: SparkSession, d: str) -> DataFrame:
    """The key that has nine tenths of the rows is cut along time, whatever the size of the input."""
    rows = bridge.read(spark, d, "events").withColumn("k", F.expr(HOT))
    right = rows.where("event_type = 'signup'").select("k", F.col("ts").alias("at"), (F.col("event_id") % 1000).alias("match"))
    return asof_left(rows.select("k", "event_id", "ts"), right, ["k"], "ts", "at", ["match"], split=0).select("event_id", "match")


@query(
    f"""SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, date_diff('second', lag(ts) OVER w, ts) AS seconds FROM (SELECT *, {HOT} AS k FROM events)
WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)"""
)
def neighbours_hot_key(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.read(spark, d, "events").select("event_id", "ts", F.expr(HOT).alias("k"))
    found = neighbours(rows, ["k"], ["ts", "event_id"], before={"before": "event_id", "_ts": "ts"}, after={"after": "event_id"}, split=0)
    return found.select("event_id", "before", "after", seconds_between(F.col("_ts"), F.col("ts")).alias("seconds"))


CITY = f"""t AS (SELECT snapshot_ts, sum(num_bikes_available) AS b FROM status_grid GROUP BY 1),
av AS (SELECT {WDL} AS weekday, {HRL} AS local_hour, avg(b) AS m FROM t GROUP BY 1, 2)"""


@query(CITY + " SELECT min(m) AS mean, arg_min(weekday, (m, local_hour, weekday)) AS weekday, arg_min(local_hour, (m, local_hour, weekday)) AS local_hour FROM av WHERE weekday <= 4 AND local_hour BETWEEN 6 AND 10", "status_grid")
def dip_argmin(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.availability_rows(bridge.catalog(spark, d, grid=True)).where("weekday <= 4 and local_hour between 6 and 10")
    least = F.min(F.struct(F.col("mean_bikes_available").alias("mean"), "local_hour", "weekday")).alias("x")
    return rows.agg(least).select("x.mean", "x.weekday", "x.local_hour")


@query(CITY + " SELECT weekday, local_hour, round(m, 9) AS mean FROM av ORDER BY m DESC, weekday, local_hour LIMIT 1", "status_grid")
def peak_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.peak(metrics.availability_rows(bridge.catalog(spark, d, grid=True)), "mean_bikes_available", "weekday", "local_hour")
    return rows.select("weekday", "local_hour", F.round("mean_bikes_available", 9).alias("mean"))


@query(
    f"""t AS (SELECT snapshot_ts, bezirk, sum(num_bikes_available) AS b FROM status_grid JOIN areas USING (source, station_id) GROUP BY 1, 2),
av AS (SELECT {WDL} AS weekday, {HRL} AS local_hour, bezirk, avg(b) AS m FROM t GROUP BY 1, 2, 3)
SELECT bezirk, local_hour, round(avg(m), 9) AS mean_of_means FROM av WHERE weekday <= 4 GROUP BY 1, 2""",
    "status_grid", "areas",
)
def bezirk_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.availability_rows(bridge.catalog(spark, d, grid=True), "bezirk").where("weekday <= 4")
    return rows.groupBy("bezirk", "local_hour").agg(F.round(F.avg("mean_bikes_available"), 9).alias("mean_of_means"))


@query(
    CITY + " SELECT weekday, local_hour, CAST(CASE WHEN m / 40 >= 3 THEN 3 WHEN m / 40 >= 1 THEN 2 WHEN m / 40 >= 0.05 THEN 1 ELSE 0 END AS INT) AS bin FROM av",
    "status_grid",
)
def map_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.availability_rows(bridge.catalog(spark, d, grid=True))
    return rows.select("weekday", "local_hour", step_bin(F.col("mean_bikes_available") / 40).alias("bin"))


@query(
    _weather("precipitation_mm", ">= 0.1", "rainy", "dry").partition("\nSELECT")[0]
    + """,
pt AS (SELECT max(temperature_c) AS v, bool_or(miss) AS miss FROM sw GROUP BY snapshot_ts, l),
al AS (SELECT 'rain' AS kind, bucket FROM cl UNION ALL SELECT 'temperature', CASE WHEN miss OR v IS NULL THEN 'excluded' WHEN v < 10.0 THEN 'cold' ELSE 'warm' END FROM pt)
SELECT kind, bucket, count(al.bucket) AS n_snapshots, count(al.bucket) = 0 AS missing
FROM (VALUES ('rain', 'rainy'), ('rain', 'dry'), ('temperature', 'cold'), ('temperature', 'warm')) want(kind, bucket) LEFT JOIN al USING (kind, bucket) GROUP BY 1, 2""",
    "status_grid", "weather",
)
def weather_bucket_report(spark: SparkSession, d: str) -> DataFrame:
    catalog = bridge.catalog(spark, d, grid=True)
    return metrics.weather_buckets(catalog, "rain").unionByName(metrics.weather_buckets(catalog, "temperature"))


#: Days of the week, Sunday first, and new names for two kinds of events.
DAY_LABELS = {1: "Sun", 2: "Mon", 3: "Tue", 4: "Wed", 5: "Thu", 6: "Fri", 7: "Sat"}
EVENT_LABELS = {"click": "tap", "signup": "join"}


@query(
    """SELECT CASE dayofweek(ts) WHEN 0 THEN 'Sun' WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' END AS dow,
  CASE event_type WHEN 'click' THEN 'tap' WHEN 'signup' THEN 'join' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1, 2"""
)
def relabelled_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.read(spark, d, "events")
    return rows.groupBy(relabel(F.dayofweek("ts"), DAY_LABELS).alias("dow"), relabel(F.col("event_type"), EVENT_LABELS).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS slug, CASE WHEN length(n_name) > 9 THEN substr(n_name, 1, 8) || '…' ELSE n_name END AS short,
  round(1 / (1 + exp((10.0 - n_nationkey) / 3.0)), 9) AS curve, CASE WHEN n_nationkey < 5 THEN '[0,5)' WHEN n_nationkey < 12 THEN '[5,12)' WHEN n_nationkey < 20 THEN '[12,20)' END AS bin FROM nation"""
)
def labels_and_curves(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    return bridge.read(spark, d, "nation").select(
        key, slug(F.col("n_name")).alias("slug"), ellipsis(F.col("n_name"), 9).alias("short"), F.round(s_curve(key, 10.0, 3.0), 9).alias("curve"), left_closed(key, [0, 5, 12, 20]).alias("bin")
    )


@query(
    f"SELECT event_id, {_local('ts')} AS local_ts, CAST({_local('ts')} AS DATE) AS local_date, {WD.format(_local('ts'))} AS weekday, {HR.format(_local('ts'))} AS hour, "
    f"date_trunc('hour', ts) AS utc_hour, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, {_utc('CAST(ts AS DATE)')} AS day_start FROM events"
)
def local_time_columns(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.localtime import start_of, weekday

    ts = F.col("ts").cast("timestamp_ntz")
    return bridge.read(spark, d, "events").select(
        "event_id", local(ts).alias("local_ts"), F.to_date(local(ts)).alias("local_date"), weekday(local(ts)).alias("weekday"), F.hour(local(ts)).alias("hour"),
        hour_of(ts).alias("utc_hour"), epoch(ts).alias("epoch_s"), start_of(F.to_date(ts)).alias("day_start"),
    )


POLYGONS = {
    "west": [[(0, 0), (6, 0), (6, 4), (0, 4)], [(1.05, 0.55), (2.05, 0.55), (2.05, 1.55), (1.05, 1.55)]],
    "east": [[(6, 0), (10, 0), (10, 4), (6, 4)]],
    "spike": [[(3, 1), (5, 1.5), (4.2, 3.7)]],
}


def polygons(spark: SparkSession) -> DataFrame:
    from ..functions.geo import GEOMETRY

    rows = [(name, [[[(float(x), float(y)) for x, y in ring] for ring in rings]]) for name, rings in POLYGONS.items()]
    return spark.createDataFrame(rows, f"name string, geometry {GEOMETRY}")


EDGES = ", ".join(
    f"('{name}', {r}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for name, rings in POLYGONS.items() for r, ring in enumerate(rings) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)
)
POINTS = "pt AS (SELECT c_custkey AS id, (c_custkey % 100) / 10 AS lon, (c_custkey % 37) / 10 AS lat FROM customer)"


@query(
    f"""WITH {POINTS}, ed AS (SELECT * FROM (VALUES {EDGES}) t(name, ring, x1, y1, x2, y2)),
rg AS (SELECT id, name, ring, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(CAST(y2 - y1 AS DOUBLE), 0)) % 2 = 1 AS hit FROM pt, ed GROUP BY 1, 2, 3)
SELECT id, name FROM rg GROUP BY 1, 2 HAVING bool_or(hit) FILTER (ring = 0) AND NOT coalesce(bool_or(hit) FILTER (ring > 0), false)"""
)
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import within

    points = bridge.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 100) / 10).alias("lon"), ((F.col("c_custkey") % 37) / 10).alias("lat"))
    # Shapes of a few edges need no parting: the cells of their own size do.
    return within(points, polygons(spark), steps=0).select("id", "name")


BOXES = ", ".join(f"('{n}', {min(x for x, _ in r[0])}, {max(x for x, _ in r[0])}, {min(y for _, y in r[0])}, {max(y for _, y in r[0])})" for n, r in POLYGONS.items())


@query(f"WITH {POINTS} SELECT id, name FROM pt JOIN (VALUES {BOXES}) b(name, x0, x1, y0, y1) ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
def bbox_prefilter(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import in_boxes

    points = bridge.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 100) / 10).alias("lon"), ((F.col("c_custkey") % 37) / 10).alias("lat"))
    return in_boxes(points, polygons(spark)).select("id", "name")


#: A city of some 24 areas that share borders, their corners where the customers' positions are shifted by ids.
CITY_CORNERS = """corner AS (SELECT c_custkey % 7 AS i, c_custkey // 7 % 5 AS j, min(c_custkey) AS m FROM customer GROUP BY ALL),
spot AS (SELECT i, j, i * 1.5 + (m * 37 % 11) / 20.0 AS lon, j * 0.9 + (m * 53 % 7) / 20.0 AS lat FROM corner),
area AS (SELECT 'a' || a.i || a.j AS name, [a.lon, b.lon, c.lon, d.lon] AS xs, [a.lat, b.lat, c.lat, d.lat] AS ys FROM spot a
  JOIN spot b ON b.i = a.i + 1 AND b.j = a.j JOIN spot c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN spot d ON d.i = a.i AND d.j = a.j + 1),
ed AS (SELECT name, unnest(xs)::DOUBLE AS x1, unnest(ys)::DOUBLE AS y1, unnest([xs[2], xs[3], xs[4], xs[1]])::DOUBLE AS x2, unnest([ys[2], ys[3], ys[4], ys[1]])::DOUBLE AS y2 FROM area)"""


def city(spark: SparkSession, d: str) -> DataFrame:
    """The same areas: name, geometry."""
    key = F.col("c_custkey")
    corner = bridge.read(spark, d, "customer").groupBy((key % 7).alias("i"), (F.floor(key / 7) % 5).alias("j")).agg(F.min("c_custkey").alias("m"))
    spot = corner.select("i", "j", F.struct((F.col("i") * 1.5 + (F.col("m") * 37 % 11) / 20.0).alias("lon"), (F.col("j") * 0.9 + (F.col("m") * 53 % 7) / 20.0).alias("lat")).alias("p"))
    at = lambda i, j, name: spot.select((F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"), F.col("p").alias(name))
    whole = at(0, 0, "a").join(at(1, 0, "b"), ["i", "j"]).join(at(1, 1, "c"), ["i", "j"]).join(at(0, 1, "d"), ["i", "j"])
    return whole.select(F.concat(F.lit("a"), F.col("i").cast("string"), F.col("j").cast("string")).alias("name"), F.array(F.array(F.array("a", "b", "c", "d"))).alias("geometry"))


@query(
    f"""WITH {POINTS}, {CITY_CORNERS},
lv AS (SELECT name, 4 + CAST(floor(log2(360.0) - log2(greatest(max(x1) - min(x1), max(y1) - min(y1)))) AS INT) AS z FROM ed GROUP BY 1),
cell AS (SELECT id, name, lon, lat, 360.0 / power(2, z) AS w, floor((lon + 180) / w) * w - 180 AS x0, floor((lat + 180) / w) * w - 180 AS y0 FROM pt, lv),
t AS (SELECT id, c.name,
  bool_or(greatest(x1, x2) >= x0 - 1e-9 AND least(x1, x2) <= x0 + w + 1e-9 AND greatest(y1, y2) >= y0 - 1e-9 AND least(y1, y2) <= y0 + w + 1e-9
    AND least((x2 - x1) * (y0 - y1) - (y2 - y1) * (x0 - x1), (x2 - x1) * (y0 - y1) - (y2 - y1) * (x0 + w - x1),
      (x2 - x1) * (y0 + w - y1) - (y2 - y1) * (x0 - x1), (x2 - x1) * (y0 + w - y1) - (y2 - y1) * (x0 + w - x1)) <= (abs(x2 - x1) + abs(y2 - y1)) * 1e-9
    AND greatest((x2 - x1) * (y0 - y1) - (y2 - y1) * (x0 - x1), (x2 - x1) * (y0 - y1) - (y2 - y1) * (x0 + w - x1),
      (x2 - x1) * (y0 + w - y1) - (y2 - y1) * (x0 - x1), (x2 - x1) * (y0 + w - y1) - (y2 - y1) * (x0 + w - x1)) >= -(abs(x2 - x1) + abs(y2 - y1)) * 1e-9) AS ray,
  count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1 AS hit
  FROM cell c JOIN ed ON ed.name = c.name GROUP BY 1, 2)
SELECT name, count(*) AS candidates, count(*) FILTER (ray) AS ray_casts, count(*) FILTER (hit) AS points FROM t WHERE ray OR hit GROUP BY 1"""
)
def ray_casts(spark: SparkSession, d: str) -> DataFrame:
    """Of every area: the points that meet one of its cells, those that must cast a ray, and those that it holds."""
    from ..operators.cover import in_edges
    from ..operators.spatial import candidates

    points = bridge.read(spark, d, "customer").select(((F.col("c_custkey") % 100) / 10).alias("lon"), ((F.col("c_custkey") % 37) / 10).alias("lat"))
    hit = F.col("inside") | in_edges()
    return candidates(points, city(spark, d)).groupBy("name").agg(F.count("*").alias("candidates"), F.count_if(~F.col("inside")).alias("ray_casts"), F.count_if(hit).alias("points"))


#: Metres from centre to corner of the query's cells.
HEX_METRES = 20_000.0
PLANE = "CROSS JOIN (SELECT 6371008.8 * pi() / 180 AS m) CROSS JOIN (SELECT 20000.0::DOUBLE AS s)"


@query(
    f"""WITH {POINTS}, f AS (SELECT id, ((lon * m) * (sqrt(3.0) / 3) - (lat * m) / 3) / s AS q, (lat * m) * (2.0 / 3) / s AS r, lon * m AS px, lat * m AS py FROM pt {PLANE}),
near AS (SELECT id, CAST(floor(q) AS BIGINT) + a AS cq, CAST(floor(r) AS BIGINT) + b AS cr, px, py FROM f, unnest([-1, 0, 1, 2]) x(a), unnest([-1, 0, 1, 2]) y(b)),
best AS (SELECT id, arg_min({{'q': cq, 'r': cr}}, pow((cq + cr / 2) * sqrt(3.0) * 20000 - px, 2) + pow(cr * 30000.0 - py, 2)) AS c FROM near GROUP BY 1)
SELECT c.q AS q, c.r AS r, count(*) AS points FROM best GROUP BY 1, 2"""
)
def hex_cells(spark: SparkSession, d: str) -> DataFrame:
    """The oracle takes the nearest of sixteen centres."""
    from ..functions.geo import hex_cell, hex_plane

    points = bridge.read(spark, d, "customer").select(((F.col("c_custkey") % 100) / 10).alias("lon"), ((F.col("c_custkey") % 37) / 10).alias("lat"))
    return points.groupBy(hex_cell(*hex_plane(F.col("lon"), F.col("lat")), HEX_METRES).alias("c")).agg(F.count("*").alias("points")).select("c.q", "c.r", "points")


@query(
    """WITH c AS (SELECT c_custkey % 100 AS q, c_custkey % 37 - 18 AS r, count(*) AS n FROM customer GROUP BY ALL),
o AS (SELECT a, b FROM unnest([-2, -1, 0, 1, 2]) x(a), unnest([-2, -1, 0, 1, 2]) y(b) WHERE abs(a + b) <= 2)
SELECT q + a AS q, r + b AS r, CAST(sum(n) AS BIGINT) AS near FROM c, o GROUP BY ALL"""
)
def hex_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Customers within two steps of every cell."""
    from ..functions.geo import hex_ring

    cells = bridge.read(spark, d, "customer").groupBy((F.col("c_custkey") % 100).alias("q"), (F.col("c_custkey") % 37 - 18).alias("r")).agg(F.count("*").alias("n"))
    spread = cells.select("n", F.explode(hex_ring(F.struct("q", "r"), 2)).alias("c"))
    return spread.groupBy("c.q", "c.r").agg(F.sum("n").alias("near"))


VERTICES = ", ".join(f"('{n}', {r}, {k}, {x}::DOUBLE, {y}::DOUBLE)" for n, rings in POLYGONS.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring))


@query(
    f"""WITH attributes AS (SELECT CASE r_regionkey WHEN 0 THEN 'west' WHEN 1 THEN 'spike' ELSE 'nowhere' END AS name, r_name AS region FROM region)
SELECT name, 0 AS polygon, ring, position, lon, lat, region FROM (VALUES {VERTICES}) v(name, ring, position, lon, lat) JOIN attributes USING (name)"""
)
def polygon_outlines(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import outlines

    name = F.when(F.col("r_regionkey") == 0, "west").when(F.col("r_regionkey") == 1, "spike").otherwise("nowhere")
    return outlines(polygons(spark), bridge.read(spark, d, "region").select(name.alias("name"), F.col("r_name").alias("region")))
