"""Shapefiles written byte by byte, and the grid against the forward projection."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from pedalflow.operators.spatial import within
from pedalflow.sources import shapes


def forward(lon, lat):
    """Feet east and north of a point, by the projection's forward formulas."""
    f = 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    rad = math.radians

    def m(p):
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p):
        return math.sqrt((1 - math.sin(p)) / (1 + math.sin(p)) * ((1 + e * math.sin(p)) / (1 - e * math.sin(p))) ** e)

    p1, p2, p0 = rad(40 + 2 / 3), rad(41 + 2 / 60), rad(40 + 10 / 60)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    rho, rho0 = 6378137 * big * t(rad(lat)) ** n, 6378137 * big * t(p0) ** n
    theta = n * rad(lon + 74)
    return (300000 + rho * math.sin(theta)) * 3937 / 1200, (rho0 - rho * math.cos(theta)) * 3937 / 1200


def shape_file(records):
    body = b""
    for number, rings in enumerate(records, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            begins = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            content = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *begins) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", number, len(content) // 2) + content
    return bytes(100) + body


def table_file(names, deleted=()):
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15)
    rows = b"".join((b"*" if k in deleted else b" ") + n.encode().ljust(8) for k, n in enumerate(names))
    return bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(names), 65, 9) + bytes(20) + fields + b"\r" + rows


def square(x, y, size, clockwise=True):
    ring = [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]
    return ring if clockwise else ring[::-1]


def test_shapefile_with_holes_parts_blanks_and_deleted_rows(spark, tmp_path):
    records = [[square(0, 0, 10), square(2, 2, 2, False), square(20, 0, 5)], None, [square(40, 0, 5, False)], [square(60, 0, 5)]]
    (tmp_path / "a.shp").write_bytes(shape_file(records))
    (tmp_path / "a.dbf").write_bytes(table_file(["holed", "", "turned", "gone"], {3}))
    rows = shapes.read_shapefile(spark, str(tmp_path / "a.shp"), "NAME", grid=False)
    found = {r.name: r for r in rows.collect()}
    assert set(found) == {"holed", None, "turned"} and found[None].geometry is None and found[None].properties == {"NAME": None}
    assert [len(p) for p in found["holed"].geometry] == [2, 1] and len(found["turned"].geometry) == 1
    points = spark.createDataFrame([("in", 1.0, 1.0), ("hole", 3.0, 3.0), ("part", 22.0, 1.0), ("turned", 41.0, 1.0), ("out", 15.0, 1.0)], "id string, lon double, lat double")
    assert {(r.id, r.name) for r in within(points, rows.select("name", "geometry")).collect()} == {("in", "holed"), ("part", "holed"), ("turned", "turned")}


def test_the_grid_turns_back_into_degrees(spark, tmp_path):
    corners = [(-74.0, 40 + 1 / 6), (-73.9857, 40.7484), (-74.25, 40.5), (-71.9, 41.1)]
    rows = spark.createDataFrame([(*forward(*c), *c) for c in corners], "x double, y double, lon double, lat double")
    lon, lat = shapes.degrees_of(F.col("x"), F.col("y"))
    assert rows.select(F.max(F.abs(lon - F.col("lon"))).alias("a"), F.max(F.abs(lat - F.col("lat"))).alias("b")).first() == pytest.approx((0, 0), abs=1e-9)
    assert forward(*corners[0]) == pytest.approx((984250.0, 0.0), abs=1e-6)
    (tmp_path / "g.shp").write_bytes(shape_file([[[forward(*c) for c in corners]]]))
    (tmp_path / "g.dbf").write_bytes(table_file(["grid"]))
    ring = shapes.read_shapefile(spark, str(tmp_path / "g.shp"), "NAME").first().geometry[0][0]
    assert [(p.lon, p.lat) for p in ring] == [pytest.approx(c, abs=1e-9) for c in corners]


def test_lines_are_no_polygons():
    record = struct.pack("<i", 3)
    with pytest.raises(ValueError, match="no polygon"):
        list(shapes.shapes_in(bytes(100) + struct.pack(">2i", 1, 2) + record))
