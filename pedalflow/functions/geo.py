"""Points, polygons and grid cells as columns, without user functions.

A polygon is an array of rings, a ring an array of (lon, lat) structs, a geometry an array of polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
EARTH_RADIUS = 6_371_008.8
CELL_METRES = 500.0

RING = "array<struct<lon: double, lat: double>>"
GEOMETRY = f"array<array<{RING}>>"


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray to the east crosses an odd number of edges. Borders follow the strict comparisons."""
    n = F.size(ring)

    def crosses(index: Column) -> Column:
        a, b = F.get(ring, index), F.get(ring, (index + 1) % n)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return F.coalesce(spans & (lon < at), F.lit(False))

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda acc, i: acc != crosses(i))
    return F.when(n > 0, hits).otherwise(F.lit(False))


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lon, lat, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda r: in_ring(lon, lat, r))


def in_geometry(lon: Column, lat: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda p: in_polygon(lon, lat, p))


def bounding_box(polygons: Column) -> dict[str, Column]:
    """The closed box around all points."""
    points = F.flatten(F.flatten(polygons))
    return {
        "min_lon": F.array_min(F.transform(points, lambda p: p["lon"])),
        "max_lon": F.array_max(F.transform(points, lambda p: p["lon"])),
        "min_lat": F.array_min(F.transform(points, lambda p: p["lat"])),
        "max_lat": F.array_max(F.transform(points, lambda p: p["lat"])),
    }


def in_box(lon: Column, lat: Column) -> Column:
    return lon.between(F.col("min_lon"), F.col("max_lon")) & lat.between(F.col("min_lat"), F.col("max_lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Metres along the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def grid_cell(lat: Column, lon: Column, metres: float = CELL_METRES) -> Column:
    """The name of a cell of about that size: rows of equal latitude, columns scaled by the row's latitude."""
    step = metres / 111_195.0
    row = F.floor(lat / step)
    column = F.floor(lon * F.cos(F.radians((row + 0.5) * step)) / step)
    return F.concat(F.lit("g"), row.cast("string"), F.lit(":"), column.cast("string"))


HEX = "struct<q: bigint, r: bigint>"


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _axial(q: Column, r: Column) -> Column:
    return F.struct(q.cast("long").alias("q"), r.cast("long").alias("r"))


def _nearest(q: Column, r: Column) -> Column:
    """Cube rounding: all three coordinates (q, r and what makes their sum 0) are rounded, and the one that moved
    farthest follows from the others."""
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return _axial(F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq), F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr))


def hex_plane(lon: Column, lat: Column, origin_lat: float = 0.0) -> tuple[Column, Column]:
    """Metres east and north on a plate that is true to scale at origin_lat."""
    metre = math.radians(1) * EARTH_RADIUS
    return lon * (metre * math.cos(math.radians(origin_lat))), lat * metre


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """Axial coordinates (q, r) of the hexagon, corners up, with this distance from centre to corner, that a point of
    the plane lies in; null where a coordinate is null. Of cells whose centres are equally near, as on a border, the
    one with the smallest q, then r, has the point."""
    place = F.struct(((x * (math.sqrt(3) / 3) - y / 3) / size).alias("q"), (y * (2 / 3) / size).alias("r"), x.alias("x"), y.alias("y"))
    ring = [(q, r) for q in (-1, 0, 1) for r in (-1, 0, 1) if abs(q + r) <= 1]

    def ranked(p: Column, q: Column, r: Column) -> Column:
        far = F.pow((q + r / 2) * math.sqrt(3) * size - p["x"], 2) + F.pow(r * (1.5 * size) - p["y"], 2)
        return F.struct(far.alias("far"), q.alias("q"), r.alias("r"))

    # Rounding alone would leave a border to the last digits of the coordinates.
    best = _once(place, lambda p: _once(_nearest(p["q"], p["r"]), lambda c: F.least(*[ranked(p, c["q"] + q, c["r"] + r) for q, r in ring])))
    return F.when(x.isNotNull() & y.isNotNull(), _once(best, lambda c: _axial(c["q"], c["r"])))


def hex_centre(cell: Column, size: float) -> Column:
    """(x, y) of a hexagon's centre."""
    x = (cell["q"] + cell["r"] / 2) * (math.sqrt(3) * size)
    return F.struct(x.alias("x"), (cell["r"] * (1.5 * size)).alias("y"))


def hex_distance(a: Column, b: Column) -> Column:
    """Steps from cell to cell."""
    dq, dr = a["q"] - b["q"], a["r"] - b["r"]
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def hex_ring(cell: Column, k: int) -> Column:
    """All cells within k steps, as an array by q, then r: 1 + 3 k (k + 1) of them."""
    offsets = [(q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if abs(q + r) <= k]
    return F.when(cell.isNotNull(), F.array(*[_axial(cell["q"] + q, cell["r"] + r) for q, r in offsets]))


def hex_parent(cell: Column) -> Column:
    """The cell of three times the size, of like orientation, that a cell's centre lies in: nine children each."""
    return F.when(cell.isNotNull(), _nearest(cell["q"] / F.lit(3.0), cell["r"] / F.lit(3.0)))


def hex_name(cell: Column) -> Column:
    return F.concat(F.lit("h"), cell["q"].cast("string"), F.lit(":"), cell["r"].cast("string"))


def rounded_rings(polygons: Column, digits: int = 5) -> Column:
    """Coordinates rounded, and vertices that then equal the one before them left out."""

    def ring(points: Column) -> Column:
        near = F.transform(points, lambda p: F.struct(F.round(p["lon"], digits).alias("lon"), F.round(p["lat"], digits).alias("lat")))
        return F.filter(near, lambda p, i: (i == 0) | (p != F.get(near, i - 1)))

    return F.transform(polygons, lambda rings: F.transform(rings, ring))


#: Digits of base 32, as ``conv`` writes them, and the characters for those that more digits follow and for last ones.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
GOES_ON, LAST = "".join(map(chr, range(95, 127))), "".join(map(chr, range(63, 95)))


def encode_polyline(points: Column, digits: int = 5) -> Column:
    """The text that ``decode_polyline`` reads, of an array of (lon, lat); null stays null, no point gives an empty text."""
    rounded = F.transform(points, lambda p: F.struct(F.round(p["lat"] * 10**digits).cast("long").alias("a"), F.round(p["lon"] * 10**digits).cast("long").alias("b")))

    def text(move: Column) -> Column:
        signed = F.when(move < 0, -2 * move - 1).otherwise(2 * move)
        # Smallest digit first.
        written = F.reverse(F.conv(signed.cast("string"), 10, 32))
        return _once(written, lambda w: F.concat(F.translate(F.left(w, F.length(w) - 1), DIGITS, GOES_ON), F.translate(F.right(w, F.lit(1)), DIGITS, LAST)))

    def line(whole: Column) -> Column:
        def moves(p: Column, i: Column) -> Column:
            last = F.when(i > 0, F.get(whole, i - 1))
            return F.array(*[p[x] - F.coalesce(last[x], F.lit(0)) for x in ("a", "b")])

        return F.array_join(F.transform(F.flatten(F.transform(whole, moves)), text), "")

    return _once(rounded, line)


def decode_polyline(text: Column, digits: int = 5) -> Column:
    """An encoded polyline as an array of (lon, lat): numbers in chunks of five bits, signs in the lowest bit, each point
    as its difference from the one before. The work is in proportion to the text."""
    # Each number is a run of characters that go on and one that ends it; a rest without an end is none.
    numbers = F.regexp_extract_all(text, F.lit("[_-~]*[?-^]"), F.lit(0))

    def signed(number: Column) -> Column:
        value = F.conv(F.reverse(F.translate(number, GOES_ON + LAST, DIGITS + DIGITS)), 32, 10).cast("long")
        return _once(value, lambda v: F.when(v % 2 == 1, -F.shiftright(v, 1) - 1).otherwise(F.shiftright(v, 1)))

    def walk(steps: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon"), F.array().cast(RING).alias("out"))

        def take(state: Column, k: Column) -> Column:
            lat, lon = state["lat"] + F.get(steps, 2 * k), state["lon"] + F.get(steps, 2 * k + 1)
            point = F.struct((lon / F.lit(10.0**digits)).alias("lon"), (lat / F.lit(10.0**digits)).alias("lat"))
            return F.struct(lat.alias("lat"), lon.alias("lon"), F.concat(state["out"], F.array(point)).alias("out"))

        n = F.floor(F.size(steps) / 2).cast("int")
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, take, lambda s: s["out"])).otherwise(F.array().cast(RING))

    return F.when(text.isNotNull(), _once(F.transform(numbers, signed), walk))
