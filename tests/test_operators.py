import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from pedalflow.operators.asof import asof_left
from pedalflow.operators.intervals import trailing_distinct, without_overlap
from pedalflow.plans.trips import quantiles

D0 = date(2024, 1, 1)


@pytest.mark.parametrize("calendar", [None, ("2024-01-20", "2024-05-01")])
def test_trailing_distinct_against_counting(spark, calendar):
    rnd = random.Random(1)
    rows = [(D0 + timedelta(days=rnd.choice((rnd.randrange(40), rnd.randrange(100)))), rnd.randrange(8)) for _ in range(60)] + [(D0, None)]
    got = {r.date: r.n for r in trailing_distinct(spark.createDataFrame(rows, "d date, i int"), "d", "i", 28, "n", calendar).collect()}
    seen = [(d, i) for d, i in rows if i is not None]
    first, last = (min(d for d, _ in seen), max(d for d, _ in seen)) if calendar is None else map(date.fromisoformat, calendar)
    want = {}
    for k in range((last - first).days + 1):
        day = first + timedelta(days=k)
        n = len({i for d, i in seen if day - timedelta(days=27) <= d <= day})
        if n:
            want[day] = n
    assert got == want


def test_asof_takes_the_latest_not_later_and_equal_times_match(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    left = spark.createDataFrame([("a", t(1), 1), ("a", t(3), 2), ("a", t(5), 3), ("b", t(5), 4)], "k string, t timestamp_ntz, i int")
    right = spark.createDataFrame([("a", t(3), "x"), ("a", t(4), "y"), ("c", t(1), "z")], "k string, u timestamp_ntz, v string")
    got = {r.i: r.v for r in asof_left(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: None, 2: "x", 3: "y", 4: None}


@pytest.mark.parametrize("split", [None, 0])
def test_overlaps_touching_ends_do_not_count(spark, split):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(i, "s", t(30 * i), t(30 * i + 40)) for i in range(20)]
    gaps = [("s", t(100), t(110)), ("s", t(105), t(300)), ("other", t(0), t(600)), ("s", t(400), t(400))]
    got = {r.i for r in without_overlap(spark.createDataFrame(rows, "i int, k string, a timestamp_ntz, b timestamp_ntz"), spark.createDataFrame(gaps, "k string, gap_start timestamp_ntz, gap_end timestamp_ntz"), "k", "a", "b", split=split).collect()}
    assert got == {i for i, _, a, b in rows if not any(k == "s" and g < b and h > a for k, g, h in gaps)}


def test_plans_have_no_product_joins(spark):
    from pedalflow.plans import catalogue

    for name in ("empty_minutes_station", "net_flow_bezirk", "asof_latest", "point_in_polygon", "active_28d_bikes", "full_days_rows"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from pedalflow.sources import bridge

    plan = bridge.gaps(spark, "/root/testdata/sf0.001").where(F.col("gap_start") > F.lit("2024-01-01").cast("timestamp_ntz"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan and "props" not in plan


def test_polylines_are_written_as_they_are_read(spark):
    from pyspark.sql import functions as F

    from pedalflow.functions import geo

    # The example of the format, with its text.
    known = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    rows = [(0, known), (1, [(0.0, 0.0), (179.99999, -90.0), (-180.0, 90.0), (-180.0, 90.0)]), (2, []), (3, None), (4, [(0.00001, -0.00001)])]
    df = spark.createDataFrame(rows, f"k int, p {geo.RING}").withColumn("text", geo.encode_polyline(F.col("p"))).withColumn("back", geo.decode_polyline(F.col("text")))
    got = {r.k: (r.text, r.back if r.back is None else [tuple(x) for x in r.back]) for r in df.collect()}
    assert got[0] == ("_p~iF~ps|U_ulLnnqC_mqNvxq`@", known)
    assert got[1][1] == rows[1][1] and got[2] == ("", []) and got[3] == (None, None) and got[4][1] == rows[4][1]


def test_long_polylines_take_time_in_proportion(spark):
    """Reading number by number for every point again would take hours here."""
    import time

    from pyspark.sql import functions as F

    from pedalflow.functions import geo

    line = [(i * 7919 % 36_000_000 / 1e5 - 180, i * 104_729 % 18_000_000 / 1e5 - 90) for i in range(3000)]
    df = spark.createDataFrame([(line,)], f"p {geo.RING}")
    began = time.monotonic()
    found = df.select(geo.decode_polyline(geo.encode_polyline(F.col("p"))).alias("x")).head().x
    assert time.monotonic() - began < 60
    assert [(round(p.lon * 1e5), round(p.lat * 1e5)) for p in found] == [(round(x * 1e5), round(y * 1e5)) for x, y in line]


def test_polylines_ticks_and_pseudonyms(spark):
    from pyspark.sql import functions as F

    from pedalflow.functions import geo, values

    df = spark.createDataFrame([("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), ("",), (None,)], "p string")
    got = [r.x if r.x is None else [(round(p.lon, 5), round(p.lat, 5)) for p in r.x] for r in df.select(geo.decode_polyline(F.col("p")).alias("x")).collect()]
    assert got == [[(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)], [], None]
    tops = spark.createDataFrame([(9.0,), (47.0,), (0.03,), (0.0,), (100.0,)], "t double")
    assert [r.x for r in tops.select(values.axis_ticks(F.col("t")).alias("x")).collect()] == [[0, 2, 4, 6, 8, 10], [0, 10, 20, 30, 40, 50], [0, 0.01, 0.02, 0.03], [0], [0, 20, 40, 60, 80, 100]]
    levels = spark.createDataFrame([("a",), ("b",), (None,)], "i string").select(values.relabel(F.col("i"), {"a": "x"}).alias("x"))
    assert [r.x for r in levels.collect()] == ["x", "b", None]
    names = [r.x for r in spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "i string").select(values.pseudonym(F.col("i"), "s").alias("x")).collect()]
    assert names[0] == names[1] != names[2] and names[3] is None


@pytest.mark.parametrize("values", [[], [None], [3.5], [1.0, 2.0], [0.0] * 500 + [1.0], [float(i * 7919 % 1000) / 8 for i in range(3000)] + [None] * 5])
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_by_ranks_equal_numpy_with_ties_nulls_and_no_rows(spark, values, accuracy):
    at = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.p: r.value for r in quantiles(frame, "x", at, accuracy=accuracy).collect()}
    known = [v for v in values if v is not None]
    want = {p: float(np.quantile(known, p)) if known else None for p in at}
    assert got == (pytest.approx(want, abs=1e-9) if known else want)


def test_rows_of_a_hot_key_are_dealt_evenly_and_scans_agree(spark):
    """One key has nine tenths of the rows; keys and times may be null, times repeat."""
    from pyspark.sql import functions as F

    from pedalflow.operators import scan

    n = 400_000
    ident = F.col("id")
    key = F.when(ident % 10 > 0, "hot").when(ident % 50 == 0, None).otherwise(F.concat(F.lit("k"), (ident % 70).cast("string")))
    rows = spark.range(n).select(key.alias("k"), F.when(ident % 997 > 0, F.hash(ident) % 60_000).alias("t"), "id", F.when(ident % 3 == 0, ident % 1000).alias("v"))
    parts = scan.with_segments(rows, ["k"], "t", 8)
    sizes = sorted(r[1] for r in parts.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == n and len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    order = ["t", "id"]
    for how in ("last", "max"):
        for current in (True, False):
            a, b = (scan.running(rows, ["k"], order, "v", "x", how, current, split).select("id", "x") for split in (1 << 60, 0))
            assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    a, b = (scan.neighbours(rows, ["k"], order, {"p": "id", "q": "v"}, {"r": "v"}, split).select("id", "p", "q", "r") for split in (1 << 60, 0))
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    plan = scan.running(rows, ["k"], order, "v", "x", split=0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_a_large_input_is_cut_only_where_a_key_is_hot(spark, tmp_path):
    """Cutting reads the input five times over."""
    from pyspark.sql import functions as F

    from pedalflow.operators import scan

    ident = F.col("id")
    for name, key in (("even", ident % 500), ("hot", F.when(ident % 10 > 0, 0).otherwise(ident % 500)), ("none", F.lit(None).cast("long"))):
        spark.range(20_000 if name != "none" else 0).select(key.alias("k"), (ident * 7919 % 3000).alias("t"), "id").write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        found = {split: scan.neighbours(rows, ["k"], ["t", "id"], after={"next": "id"}, split=split) for split in (0, 1, 1 << 60)}
        assert ("_segment" in found[1]._jdf.queryExecution().analyzed().toString()) == (name == "hot"), name
        want = sorted(map(tuple, found[1 << 60].collect()), key=str)
        assert all(sorted(map(tuple, found[split].collect()), key=str) == want for split in (0, 1))


def test_pairs_are_gathered_before_they_are_counted(spark):
    """Each task of the scan would hold nearly as many pairs as rows; most rows are of one pair here, some have nulls."""
    from collections import Counter

    from pedalflow.plans.trips import pair_counts

    rows = [(1, 2) if i % 3 else (i, i % 7) for i in range(3000)] + [(None, 2), (None, None), (None, None)]
    found = pair_counts(spark.createDataFrame(rows, "start_station_id long, end_station_id long").repartition(3))
    assert Counter({(r.start_station_id, r.end_station_id): r.trips for r in found.collect()}) == Counter(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RebalancePartitions")


def test_islands_against_marking(spark):
    from pedalflow.operators.intervals import islands

    rnd = random.Random(3)
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    gaps = [(rnd.choice("ab"), a, a + rnd.choice((0, 1, 5, 30, -3))) for a in (rnd.randrange(600) for _ in range(90))]
    frame = spark.createDataFrame([(k, t(a), t(b)) for k, a, b in gaps] + [("a", None, t(3))], "k string, gap_start timestamp_ntz, gap_end timestamp_ntz")
    want = []
    for k in "ab":
        for a, b in sorted({(a, b) for x, a, b in gaps if x == k and b >= a}):
            if want and want[-1][0] == k and a < want[-1][2]:
                want[-1][2] = max(want[-1][2], b)
            else:
                want.append([k, a, b])
    for split in (None, 0):
        assert sorted((r.k, r.gap_start, r.gap_end) for r in islands(frame, "k", split).collect()) == [(k, t(a), t(b)) for k, a, b in want]
    assert islands(frame.limit(0), "k").count() == 0


def areas(rnd, columns=12, rows=8, extra=6):
    """A city of areas that share borders: corners of a grid, moved, and more points along each side."""
    corner = {(i, j): (13 + i * 0.05 + rnd.uniform(-0.015, 0.015), 52.3 + j * 0.04 + rnd.uniform(-0.012, 0.012)) for i in range(columns + 1) for j in range(rows + 1)}
    sides = {}

    def side(a, b):
        if (b, a) in sides:
            return sides[b, a][::-1]
        if (a, b) not in sides:
            (x1, y1), (x2, y2) = corner[a], corner[b]
            sides[a, b] = [(x1, y1)] + [(x1 + (x2 - x1) * k / extra + rnd.uniform(-0.002, 0.002), y1 + (y2 - y1) * k / extra + rnd.uniform(-0.002, 0.002)) for k in range(1, extra)] + [(x2, y2)]
        return sides[a, b]

    out = {}
    for i in range(columns):
        for j in range(rows):
            loop = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
            out[f"a{i}-{j}"] = [p for a, b in zip(loop[:-1], loop[1:], strict=True) for p in side(a, b)[:-1]]
    return out


def test_covers_leave_few_candidates_and_the_same_points(spark):
    from pyspark.sql import functions as F

    from pedalflow.functions.geo import GEOMETRY, in_geometry
    from pedalflow.operators.spatial import candidates, in_boxes, within

    rnd = random.Random(96)
    city = areas(rnd)
    rings = [(n, [[ring]]) for n, ring in city.items()]
    # One with a hole and one of two parts, of very different sizes; one without points.
    rings += [("ring", [[[(13.0, 52.3), (13.6, 52.3), (13.6, 52.62), (13.0, 52.62)], [(13.1, 52.35), (13.5, 52.35), (13.5, 52.6), (13.1, 52.6)]]])]
    rings += [("dots", [[[(13.2, 52.4), (13.2001, 52.4), (13.2, 52.4001)]], [[(-170.0, -80.0), (10.0, 0.0), (-170.0, 60.0)]]]), ("none", [])]
    polygons = spark.createDataFrame(rings, f"name string, geometry {GEOMETRY}")
    spots = [(k, rnd.uniform(12.98, 13.62), rnd.uniform(52.28, 52.64)) for k in range(3000)] + [(9000 + k, *p) for k, p in enumerate(city["a3-3"])] + [(9999, None, 52.4)]
    points = spark.createDataFrame(spots, "id int, lon double, lat double")
    pairs = points.crossJoin(polygons).where(in_geometry(F.col("lon"), F.col("lat"), F.col("geometry")))
    want = sorted((r.id, r.name) for r in pairs.select("id", "name").collect())
    assert sorted((r.id, r.name) for r in within(points, polygons).select("id", "name").collect()) == want and len(want) > 3000
    boxes = {n: (min(x for x, _ in r), max(x for x, _ in r), min(y for _, y in r), max(y for _, y in r)) for n, r in city.items()}
    found = {(r.id, r.name) for r in in_boxes(points, polygons).select("id", "name").collect() if r.name in boxes}
    assert found == {(i, n) for i, x, y in spots if x is not None for n, (a, b, c, e) in boxes.items() if a <= x <= b and c <= y <= e}
    own = polygons.where("name like 'a%'")
    met = candidates(points.where("id < 9000"), own)
    assert met.count() < 2 * 3000 and met.where("not inside").count() < 0.6 * met.count()


def test_hexagons_are_nearest_nested_and_connected(spark):
    import math

    from pyspark.sql import functions as F

    from pedalflow.functions import geo

    rnd = random.Random(6)
    df = spark.createDataFrame([(rnd.uniform(-900, 900), rnd.uniform(-900, 900)) for _ in range(500)] + [(None, 1.0)], "x double, y double")
    cell = geo.hex_cell(F.col("x"), F.col("y"), 50.0)
    rows = df.select("x", "y", cell.alias("c")).select("x", "y", "c", geo.hex_centre(F.col("c"), 50.0).alias("m"), geo.hex_ring(F.col("c"), 1).alias("near"), geo.hex_parent(F.col("c")).alias("up"), geo.hex_name(F.col("c")).alias("name")).collect()
    assert rows[-1].c is None and rows[-1].near is None
    centre = lambda q, r: ((q + r / 2) * math.sqrt(3) * 50, r * 75)
    for row in rows[:-1]:
        own = math.dist((row.x, row.y), (row.m.x, row.m.y))
        assert len(row.near) == 7 and all(own <= math.dist((row.x, row.y), centre(n.q, n.r)) + 1e-9 for n in row.near)
        assert math.dist((row.m.x, row.m.y), [3 * v for v in centre(row.up.q, row.up.r)]) <= 150 + 1e-9 and row.name == f"h{row.c.q}:{row.c.r}"
    ring = spark.range(1).select(F.explode(geo.hex_ring(F.struct(F.lit(2).cast("long").alias("q"), F.lit(-5).cast("long").alias("r")), 3)).alias("c"))
    steps = [r[0] for r in ring.select(geo.hex_distance(F.col("c"), F.struct(F.lit(2).alias("q"), F.lit(-5).alias("r")))).collect()]
    assert sorted(steps) == [0] + [1] * 6 + [2] * 12 + [3] * 18


def test_a_row_finds_its_segment_by_halving(spark):
    from pyspark.sql import functions as F

    from pedalflow.operators import scan

    rnd = random.Random(3)
    for n in (0, 1, 7, 8, 100, 1000):
        cuts = sorted(rnd.sample(range(3000), n))
        asked = [None, -1, 0, 3001, *cuts[:20], *[rnd.randrange(3000) for _ in range(200)]]
        df = spark.createDataFrame([(cuts, v) for v in asked], "cuts array<int>, v int")
        for r in df.select("v", scan._cuts_before(F.col("cuts"), F.col("v"), 1000).alias("x")).collect():
            assert r.x == (0 if r.v is None else sum(c < r.v for c in cuts))
    # No row looks at every cut.
    rows = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("t"))
    assert "filter(_cuts" not in scan.with_segments(rows, ["k"], "t", 4)._jdf.queryExecution().analyzed().toString()


def test_borders_of_hexagons_belong_to_the_smaller_cell(spark):
    """x = 0 is the border of the cells (-(r + 1) / 2, r) and (-(r - 1) / 2, r) of every odd row, at all of its heights."""
    from pyspark.sql import functions as F

    from pedalflow.functions import geo

    df = spark.range(1, 60, 2).select(F.col("id").alias("r"), F.explode(F.array(*[F.lit(k / 11 - 0.45) for k in range(10)])).alias("k"))
    cell = geo.hex_cell(F.lit(0.0), (F.col("r") + F.col("k") / 2) * 30_000.0, 20_000.0)
    rows = df.select("r", cell.alias("c")).collect()
    assert len(rows) == 300 and all((x.c.q, x.c.r) == (-(x.r + 1) // 2, x.r) for x in rows)


def test_quantiles_of_groups_with_brackets(spark):
    from pyspark.sql import functions as F

    from pedalflow.operators.quantiles import exact_quantiles

    rnd = random.Random(7)
    rows = [(rnd.choice(("a", "b", None)), rnd.choice((1, 2)), rnd.choice((None, rnd.gauss(0, 3), float(rnd.randrange(5))))) for _ in range(6000)] + [("c", 1, None), ("d", 1, 4.0)]
    frame = spark.createDataFrame(rows, "k string, j int, v double")
    for accuracy in (25, 10_000):
        got = {(r.k, r.j, r.p): (r.value, r.n) for r in exact_quantiles(frame, ["k", "j"], "v", (0.1, 0.5, 0.999), [F.count("*").alias("n")], accuracy).collect()}
        groups = {}
        for k, j, v in rows:
            groups.setdefault((k, j), []).append(v)
        want = {(*g, p): (float(np.quantile([v for v in vs if v is not None], p)), len(vs)) for g, vs in groups.items() if g != ("c", 1) for p in (0.1, 0.5, 0.999)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_late_rows_change_the_states_of_their_own_days(spark, tmp_path):
    from pedalflow.operators.bitmaps import add_late, daily_states, read_states, trailing_counts, write_states

    rnd = random.Random(5)
    make = lambda n: [(D0 + timedelta(days=rnd.randrange(60)), rnd.choice((0, 5, 32_767, 32_768, 10**6, rnd.randrange(10**5)))) for _ in range(n)]
    early = make(300) + [(None, 4), (D0, None)]
    late = [(D0 + timedelta(days=d), i) for d in (3, 40) for i in (5, 77, 2_000_000)]
    path = str(tmp_path / "states")
    frame = lambda rows: spark.createDataFrame(rows, "d date, i long")
    write_states(daily_states(frame(early), "d", "i"), path)
    stamps = lambda: {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "states").rglob("*.parquet")}
    before = stamps()
    for _ in range(2):
        add_late(frame(late), "d", "i", path)
    kept = {f for f in before if f.parent.name[5:] not in ("2024-01-04", "2024-02-10")}
    assert len(kept) > 40 and all(before[f] == stamps()[f] for f in kept)
    got = {r.date: r.n for r in trailing_counts(read_states(spark, path), 28, "n").collect()}
    assert got == {r.date: r.n for r in trailing_distinct(frame(early + late), "d", "i", 28, "n").collect()}
