"""Quadtree covers of polygons: cells that lie inside, and cells that a border passes.

Cells of level z are squares of 360 / 2^z degrees. A polygon starts with the few cells of its own size, at most four;
cells that an edge may touch are parted, two levels at a time, and carry on only the edges that a ray to the east from
within them can cross. What no edge touches is inside or outside as a whole, which one such ray decides. Expressions
are SQL texts: lambdas over edges are parsed at once instead of being put together call by call.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times a border cell is parted, and levels each time: sides of the last ones are a polygon's size by 2^4, about.
STEPS, LEVELS = 2, 2
#: The finest level a polygon may start with, cells of some 2 metres.
FINEST = 24
#: Degrees by which edges are taken to reach farther than they do, against rounding.
MARGIN = 1e-9


def cell(at: Column, level: Column) -> Column:
    """Number of a coordinate's cell along its axis."""
    return F.floor((at + 180.0) / (F.lit(360.0) / F.pow(F.lit(2.0), level)))


def level_of(width: Column, height: Column) -> Column:
    """The level whose cells are as large as a box or larger, so that it touches at most two along each axis."""
    return F.least(F.lit(FINEST), F.floor(F.lit(math.log2(360.0)) - F.log2(F.greatest(width, height, F.lit(1e-9))))).cast("int")


#: Polygons as closed rings of edges.
EDGES = """transform(geometry, rings -> transform(rings, r -> zip_with(r, concat(slice(r, 2, greatest(size(r) - 1, 0)), slice(r, 1, 1)),
  (a, b) -> named_struct('x1', a.lon, 'y1', a.lat, 'x2', b.lon, 'y2', b.lat))))"""


def _ray(lon: str, lat: str, edges: str) -> str:
    """Whether a ray to the east crosses an odd number of edges, by the same comparisons as ``geo.in_ring``."""
    at = f"e.x1 + try_divide(({lat} - e.y1) * (e.x2 - e.x1), e.y2 - e.y1)"
    return f"size(filter({edges}, e -> coalesce((e.y1 > {lat}) != (e.y2 > {lat}) AND {lon} < {at}, false))) % 2 = 1"


def _inside(lon: str, lat: str, polygons: str = "edges") -> str:
    """Inside the first ring of a polygon and in none of its others."""
    first, others = _ray(lon, lat, "get(p, 0)"), _ray(lon, lat, "h")
    return f"exists({polygons}, p -> coalesce({first}, false) AND NOT exists(slice(p, 2, greatest(size(p) - 1, 0)), h -> {others}))"


def in_edges() -> Column:
    """Whether (lon, lat) lies within the polygons of ``edges``."""
    return F.expr(_inside("lon", "lat"))


#: The edges that a ray to the east from a point of the cell can cross.
_AHEAD = f"""CASE WHEN NOT inside THEN transform(edges, p -> transform(p, r -> filter(r, e -> greatest(e.y1, e.y2) >= south - {MARGIN} AND least(e.y1, e.y2) <= south + wide + {MARGIN}
  AND greatest(e.x1, e.x2) >= west - {MARGIN}))) END"""
_TURNS = ", ".join(f"(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1)" for x in ("west", "west + wide") for y in ("south", "south + wide"))
_SLACK = f"(abs(e.x2 - e.x1) + abs(e.y2 - e.y1)) * {MARGIN}"
#: Whether an edge meets the cell: their boxes do, and not all corners lie on one side of its line.
_BORDER = f"""coalesce(exists(flatten(flatten(edges)), e -> least(e.x1, e.x2) <= west + wide + {MARGIN} AND greatest(e.x1, e.x2) >= west - {MARGIN}
  AND least({_TURNS}) <= {_SLACK} AND greatest({_TURNS}) >= -({_SLACK})), false)"""
_CENTRE = f"NOT inside AND NOT border AND {_inside('(west + wide / 2)', '(south + wide / 2)')}"


def _judged(cells: DataFrame, rest: list[str]) -> DataFrame:
    """Cells with only the edges ahead of them, without those outside; ``inside`` ones have no edges any more."""
    wide = "360.0D / power(2.0D, z)"
    placed = cells.selectExpr(*rest, "z", "x", "y", "inside", "edges", f"{wide} AS wide", f"x * ({wide}) - 180.0D AS west", f"y * ({wide}) - 180.0D AS south")
    near = placed.selectExpr(*rest, "z", "x", "y", "inside", "wide", "west", "south", f"{_AHEAD} AS edges")
    told = near.selectExpr("*", f"{_BORDER} AS border")
    return told.where(f"inside OR border OR ({_CENTRE})").selectExpr(*rest, "z", "x", "y", "NOT border AS inside", "CASE WHEN border THEN edges END AS edges")


def cover(polygons: DataFrame, steps: int = STEPS) -> DataFrame:
    """Cells of polygons (geometry and any other columns): the other columns; z, x, y; whether the cell is ``inside``;
    and of a border cell the edges that decide about its points. Polygons without points have none."""
    rest = [f"`{c}`" for c in polygons.columns if c != "geometry"]
    first = boxes(polygons).selectExpr(*rest, "z", "explode(xs) AS x", "ys", "geometry").selectExpr(*rest, "z", "x", "explode(ys) AS y", "geometry")
    now = _judged(first.selectExpr(*rest, "z", "x", "y", "false AS inside", f"{EDGES} AS edges"), rest)
    parts = 1 << LEVELS
    inner = f"transform(sequence(0, {parts * parts - 1}), k -> named_struct('z', z + {LEVELS}, 'x', x * {parts} + k % {parts}, 'y', y * {parts} + k div {parts}))"
    for _ in range(steps):
        spread = now.selectExpr(*rest, "inside", "edges", f"explode(CASE WHEN inside THEN array(named_struct('z', z, 'x', x, 'y', y)) ELSE {inner} END) AS c")
        now = _judged(spread.selectExpr(*rest, "inside", "edges", "c.z AS z", "c.x AS x", "c.y AS y"), rest)
    return now


def boxes(polygons: DataFrame) -> DataFrame:
    """Polygons that have points, with the level of their size, their closed box, and the numbers of the cells that it
    touches along both axes."""
    flat = "flatten(flatten(geometry))"
    ends = [f"array_{end}(transform({flat}, p -> p.{axis})) AS {end}_{axis}" for axis in ("lon", "lat") for end in ("min", "max")]
    boxed = polygons.selectExpr("*", *ends).where("min_lon is not null")
    sized = boxed.withColumn("z", level_of(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")))
    return sized.withColumns({to: F.sequence(cell(F.col(f"min_{axis}"), F.col("z")), cell(F.col(f"max_{axis}"), F.col("z"))) for axis, to in (("lon", "xs"), ("lat", "ys"))})
