"""Areas, lengths, compactness, winding and envelopes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6378137.0


def _pairs(ring: Column, term) -> Column:
    """A term of every edge of a ring or line. The ring stands outside the lambda, so it is made once for all edges, however it is made."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), term)


def _edges(ring: Column, term) -> Column:
    """Sum of a term over a ring's or line's edges."""
    return F.aggregate(_pairs(ring, term), F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    """Planar area, positive when counter-clockwise."""
    return _edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area_planar(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def area_sphere(ring: Column) -> Column:
    """Square metres of a lon/lat ring on the sphere."""
    return F.abs(_edges(ring, lambda a, b: F.radians(b["x"] - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"]))))) * (EARTH_RADIUS**2 / 2)


def distance_sphere(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres between lon/lat points."""
    a, b = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def length_planar(ring: Column) -> Column:
    return _edges(ring, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def length_sphere(ring: Column) -> Column:
    return _edges(ring, lambda a, b: distance_sphere(a["x"], a["y"], b["x"], b["y"]))


def polygon_area(polygon: Column, area=area_planar) -> Column:
    """Exterior less holes, not below 0."""
    holes = F.aggregate(F.slice(polygon, F.lit(2), F.size(polygon)), F.lit(0.0), lambda acc, r: acc + area(r))
    return F.greatest(F.lit(0.0), area(F.get(polygon, F.lit(0))) - holes)


def _ratio(area: Column, length: Column) -> Column:
    return F.when((area > 0) & (length > 0), 4 * math.pi * area / (length * length)).otherwise(F.lit(0.0))


def compactness(polygon: Column, net: bool = False, area=area_planar, length=length_planar) -> Column:
    """4 pi A / L^2 of the exterior, or of the net area and the length of all rings; 0 where either is not positive."""
    if not net:
        ring = F.get(polygon, F.lit(0))
        return _ratio(area(ring), length(ring))
    return _ratio(polygon_area(polygon, area), F.aggregate(polygon, F.lit(0.0), lambda acc, r: acc + length(r)))


def despeckle(polygon: Column, limit: float, area=area_planar) -> Column:
    """The polygon without holes below an area; null where its exterior is below."""
    kept = F.concat(F.slice(polygon, 1, 1), F.filter(F.slice(polygon, F.lit(2), F.size(polygon)), lambda r: area(r) >= limit))
    return F.when(area(F.get(polygon, F.lit(0))) >= limit, kept)


def despeckle_geometry(geom: Column, limit: float, area=area_planar) -> Column:
    """Geometry without polygons, holes and closed lines below an area; open lines and points stay. Null where nothing is left."""
    polys = F.filter(F.transform(geom["polys"], lambda p: despeckle(p, limit, area)), lambda p: p.isNotNull())
    closed_line = lambda r: (F.size(r) > 3) & (F.get(r, F.lit(0)) == F.element_at(r, -1))
    lines = F.filter(geom["lines"], lambda r: ~closed_line(r) | (area(r) >= limit))
    left = (F.size(polys) > 0) | (F.size(lines) > 0) | (F.size(geom["points"]) > 0)
    return F.when(left, F.struct(geom["srid"].alias("srid"), polys.alias("polys"), lines.alias("lines"), geom["points"].alias("points")))


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.array_min(ys).alias("south"), F.array_max(ys).alias("north"))


def wound(ring: Column, counter_clockwise: bool = True) -> Column:
    """The ring in one winding."""
    area = signed_area(ring)
    return F.when(area < 0 if counter_clockwise else area > 0, F.reverse(ring)).otherwise(ring)


def wound_polygon(polygon: Column) -> Column:
    """Exterior counter-clockwise, holes clockwise."""
    return F.transform(polygon, lambda r, i: F.when(i == 0, wound(r)).otherwise(wound(r, False)))


def from_smallest(ring: Column) -> Column:
    """A closed ring that begins at its lexicographically smallest vertex."""
    open_ = F.slice(ring, F.lit(1), F.size(ring) - 1)
    at = F.array_position(open_, F.array_min(open_)).cast("int")
    return F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, F.lit(1), at - 1), F.array(F.array_min(open_)))


def closed(ring: Column) -> Column:
    """The ring with its last vertex set on its first where the gap is small against the coordinates."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    scale = F.greatest(F.abs(first["x"]), F.abs(first["y"]), F.lit(1.0))
    gap = F.hypot(last["x"] - first["x"], last["y"] - first["y"])
    return F.when((F.size(ring) > 2) & (gap > 0) & (gap < 1e-6 * scale), F.concat(F.slice(ring, F.lit(1), F.size(ring) - 1), F.array(first))).otherwise(ring)


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a closed ring: an odd number of edges crosses the ray to the east."""
    cross = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    return F.size(F.filter(_pairs(ring, cross), lambda hit: hit)) % 2 == 1


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Inside the exterior and in no hole."""
    hole = F.exists(F.slice(polygon, F.lit(2), F.size(polygon)), lambda r: in_ring(r, x, y))
    return in_ring(F.get(polygon, F.lit(0)), x, y) & ~hole
