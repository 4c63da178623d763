"""Spatial joins of points with polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_box
from .cover import LEVELS, STEPS, boxes, cell, cover, in_edges

_CELL = ("_z", "_x", "_y")


def _in_cells(points: DataFrame, sized: DataFrame, steps: int, cells: DataFrame) -> DataFrame:
    """Points (lon, lat) with the rows of ``cells`` (z, x, y) whose cell holds them. A point asks once for each level
    that polygons of these sizes have cells of: one row with an array of fewer than thirty."""
    levels = sized.agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("z", F.col("z") + LEVELS * steps, F.lit(LEVELS))))).alias("_levels"))
    own = points.join(F.broadcast(levels)).withColumn("_z", F.explode("_levels")).drop("_levels")
    asked = own.withColumns({"_x": cell(F.col("lon"), F.col("_z")), "_y": cell(F.col("lat"), F.col("_z"))})
    return asked.join(cells.withColumnsRenamed({"z": "_z", "x": "_x", "y": "_y"}), list(_CELL)).drop(*_CELL)


def in_boxes(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (lon, lat) with every polygon (name, geometry) whose closed bounding box holds them.

    Both meet by cells of the polygon's own size, an equal-key join: a polygon goes to the cells that its box touches,
    four at most, a point to its own of every size there is.
    """
    sized = boxes(polygons)
    spread = sized.withColumn("x", F.explode("xs")).withColumn("y", F.explode("ys")).drop("xs", "ys")
    return _in_cells(points, sized, 0, spread).where(in_box(F.col("lon"), F.col("lat")))


def candidates(points: DataFrame, polygons: DataFrame, steps: int = STEPS) -> DataFrame:
    """Points with every polygon that has a cell at their place; ``inside`` tells that the whole cell is in it, else
    ``edges`` has those that a ray to the east may cross."""
    return _in_cells(points, boxes(polygons), steps, cover(polygons, steps))


def within(points: DataFrame, polygons: DataFrame, steps: int = STEPS) -> DataFrame:
    """Points with every polygon that holds them: inside an outer ring and in none of its holes. Only points in cells
    that a border passes cast a ray, and only over the edges ahead of their cell."""
    return candidates(points, polygons, steps).where(F.col("inside") | in_edges()).drop("inside", "edges")


def outlines(polygons: DataFrame, attributes: DataFrame, key: str = "name") -> DataFrame:
    """Every vertex of the polygons that have attributes: key, polygon, ring, position, lon, lat, and the attributes."""
    rings = polygons.select(key, F.posexplode("geometry").alias("polygon", "_rings")).select(key, "polygon", F.posexplode("_rings").alias("ring", "_points"))
    points = rings.select(key, "polygon", "ring", F.posexplode("_points").alias("position", "_p"))
    return points.select(key, "polygon", "ring", "position", "_p.lon", "_p.lat").join(attributes, key)


def map_stations(stations: DataFrame, layers: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Stations (source, station_id, lon, lat) with one column a layer for those that exactly one polygon of every
    layer holds; and the problems: source, station_id, layer, matches, for each layer where it isn't one."""
    key = ["source", "station_id"]
    counts = None
    for name, polygons in layers.items():
        hits = within(stations.select(*key, "lon", "lat"), polygons).groupBy(*key).agg(F.array_sort(F.collect_list("name")).alias("matches"))
        layer = stations.select(*key).join(hits, key, "left").select(*key, F.lit(name).alias("layer"), F.coalesce("matches", F.array().cast("array<string>")).alias("matches"))
        counts = layer if counts is None else counts.unionByName(layer)
    good = counts.groupBy(*key).agg(*[F.max(F.when((F.col("layer") == n) & (F.size("matches") == 1), F.get("matches", F.lit(0)))).alias(n) for n in layers], F.min((F.size("matches") == 1).cast("int")).alias("_all"))
    return good.where("_all = 1").drop("_all"), counts.where(F.size("matches") != 1)
