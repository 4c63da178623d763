"""Polygon shapefiles, and the state-plane grid that they may come in."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import GEOMETRY

# The Long Island zone of the state-plane grid (EPSG 2263), on the GRS 80 ellipsoid, in US survey feet.
AXIS, FLATTENING, FOOT = 6378137.0, 1 / 298.257222101, 1200 / 3937
ORIGIN_LON, ORIGIN_LAT, NORTH_LAT, SOUTH_LAT, FALSE_EAST = -74.0, 40 + 1 / 6, 41 + 1 / 30, 40 + 2 / 3, 300000.0
#: Shape types that are polygons: flat, with heights, with measures.
POLYGONS = (5, 15, 25)


def degrees_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point of the grid, by the inverse conformal conic projection and the series for the
    latitude. The grid's datum counts as that of the degrees."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def radius(lat: float) -> float:
        return math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)

    def cone(lat: float) -> float:
        s = e * math.sin(math.radians(lat))
        return math.tan(math.pi / 4 - math.radians(lat) / 2) * ((1 + s) / (1 - s)) ** (e / 2)

    n = math.log(radius(NORTH_LAT) / radius(SOUTH_LAT)) / math.log(cone(NORTH_LAT) / cone(SOUTH_LAT))
    scale = AXIS * radius(NORTH_LAT) / (n * cone(NORTH_LAT) ** n)
    east = x * F.lit(FOOT) - F.lit(FALSE_EAST)
    north = F.lit(scale * cone(ORIGIN_LAT) ** n) - y * F.lit(FOOT)
    chi = F.lit(math.pi / 2) - F.atan(F.pow(F.hypot(east, north) / scale, F.lit(1 / n))) * 2
    series = (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    )
    lat = chi
    for k, factor in enumerate(series, 1):
        lat = lat + F.sin(chi * (2 * k)) * factor
    return F.degrees(F.atan2(east, north) / n) + F.lit(ORIGIN_LON), F.degrees(lat)


def geometry_in_degrees(geometry: Column) -> Column:
    """A geometry of grid points as one of degrees."""

    def point(p: Column) -> Column:
        lon, lat = degrees_of(p["lon"], p["lat"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.transform(geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[spans], b[spans]
    return bool(np.count_nonzero(x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])) % 2)


def _nested(rings: list[np.ndarray]) -> list[list[list[dict]]]:
    """Clockwise rings begin a polygon each; any other is a hole of one that holds its first point, and without one a
    polygon of its own."""
    area = [float(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1])) for r in rings]
    found = [[r] for r, a in zip(rings, area, strict=True) if a <= 0]
    outer = len(found)
    for r, a in zip(rings, area, strict=True):
        if a > 0:
            home = next((p for p in found[:outer] if _holds(p[0], *r[0])), None)
            if home is None:
                found.append([r])
            else:
                home.append(r)
    return [[[{"lon": x, "lat": y} for x, y in r.tolist()] for r in p] for p in found]


def shapes_in(raw: bytes) -> Iterator[list | None]:
    """The geometry of each record of a shapefile; None for a record without a shape."""
    at = 100
    while at + 8 <= len(raw):
        size = 2 * struct.unpack_from(">i", raw, at + 4)[0]
        at += 8
        kind = struct.unpack_from("<i", raw, at)[0]
        if kind == 0:
            yield None
        elif kind in POLYGONS:
            parts, points = struct.unpack_from("<2i", raw, at + 36)
            begins = [*struct.unpack_from(f"<{parts}i", raw, at + 44), points]
            xy = np.frombuffer(raw, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
            yield _nested([xy[i:j] for i, j in zip(begins[:-1], begins[1:], strict=True) if j > i])
        else:
            raise ValueError(f"no polygon: shape type {kind}")
        at += size


def attributes_in(raw: bytes, encoding: str) -> Iterator[dict[str, str | None] | None]:
    """The attributes of each record of a dBase file as texts, blank ones null; None for a deleted record."""
    rows, start, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), raw[at + 16]))
        at += 32
    for k in range(rows):
        at = start + k * width
        if raw[at : at + 1] == b"*":
            yield None
            continue
        at, found = at + 1, {}
        for name, size in fields:
            found[name] = raw[at : at + size].decode(encoding, "replace").strip(" \0") or None
            at += size
        yield found


def read_shapefile(spark: SparkSession, path: str, name: str, grid: bool = True, encoding: str = "utf-8") -> DataFrame:
    """Shapefiles (``path`` may be a glob of .shp files) with the .dbf files beside them as (name, properties,
    geometry), with ``grid`` from state-plane feet to degrees. A record without a shape has a null geometry, deleted
    records are left out. One task reads a file; files are 2 GB at most by their format."""
    stem = F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "").alias("stem")
    load = lambda p, column: spark.read.format("binaryFile").load(p).select(stem, F.col("content").alias(column))
    files = load(path, "shp").join(load(path[: -len(".shp")] + ".dbf", "dbf"), "stem")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shp, dbf in zip(batch.column("shp"), batch.column("dbf"), strict=True):
                pairs = [(a, g) for a, g in zip(attributes_in(dbf.as_py(), encoding), shapes_in(shp.as_py()), strict=True) if a is not None]
                for i in range(0, len(pairs), 256):
                    part = pairs[i : i + 256]
                    point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([list(a.items()) for a, _ in part], pa.map_(pa.string(), pa.string())), pa.array([g for _, g in part], pa.list_(pa.list_(pa.list_(point))))],
                        names=["properties", "geometry"],
                    )

    rows = files.select("shp", "dbf").mapInArrow(parse, f"properties map<string, string>, geometry {GEOMETRY}")
    geometry = geometry_in_degrees(F.col("geometry")) if grid else F.col("geometry")
    return rows.select(F.try_element_at("properties", F.lit(name)).alias("name"), "properties", geometry.alias("geometry"))
