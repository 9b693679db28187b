"""Positions of points against boxes, circles and spheres, and pixel boxes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from geolith.functions.metrics import EARTH_RADIUS, distance_sphere

# Position marks; corners are sums of two edges.
INSIDE, OUTSIDE, LEFT, TOP, RIGHT, BOTTOM = 1, 2, 4, 8, 16, 32


class Box(NamedTuple):
    """A viewport: corners in world coordinates, and its size in pixels (y grows downwards)."""

    x1: float
    y1: float
    x2: float
    y2: float
    width: float = 1.0
    height: float = 1.0

    def checked(self) -> Box:
        if self.x1 == self.x2 or self.y1 == self.y2 or not self.width or not self.height:
            raise ValueError("the box is empty")
        return self

    def position(self, x: Column, y: Column) -> Column:
        out = (x < self.x1) | (x > self.x2) | (y < self.y1) | (y > self.y2)
        mark = lambda when, bit: F.when(when, F.lit(bit)).otherwise(F.lit(0))
        edge = mark(x == self.x1, LEFT).bitwiseOR(mark(x == self.x2, RIGHT)).bitwiseOR(mark(y == self.y1, BOTTOM)).bitwiseOR(mark(y == self.y2, TOP))
        return F.when(out, F.lit(OUTSIDE)).when(edge > 0, edge).otherwise(F.lit(INSIDE))

    def to_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        b = self.checked()
        return (x - b.x1) * (b.width / (b.x2 - b.x1)), (b.y2 - y) * (b.height / (b.y2 - b.y1))

    def to_world(self, px: Column, py: Column) -> tuple[Column, Column]:
        b = self.checked()
        return px / (b.width / (b.x2 - b.x1)) + b.x1, b.y2 - py / (b.height / (b.y2 - b.y1))

    def pixel_length(self, pixels: Column) -> Column:
        """A length in pixels, along a row, in world units."""
        b = self.checked()
        return F.abs(pixels * ((b.x2 - b.x1) / b.width))

    def pixel_area_km2(self) -> float:
        b = self.checked()
        return abs((b.x2 - b.x1) / b.width * (b.y2 - b.y1) / b.height) / 1e6


def on_edge(position: Column) -> Column:
    """Whether a mark is an edge or a corner."""
    return position.bitwiseAND(F.lit(LEFT | TOP | RIGHT | BOTTOM)) != 0


def on_same_edge(p: Column, q: Column) -> Column:
    return p.bitwiseAND(q).bitwiseAND(F.lit(LEFT | TOP | RIGHT | BOTTOM)) != 0


def next_edge(position: Column) -> Column:
    """The edge that follows clockwise; a corner counts as its first edge."""
    after = {LEFT: TOP, BOTTOM | LEFT: TOP, TOP: RIGHT, TOP | LEFT: RIGHT, RIGHT: BOTTOM, TOP | RIGHT: BOTTOM, BOTTOM: LEFT, BOTTOM | RIGHT: LEFT}
    out = position
    for edge, following in after.items():
        out = F.when(position == edge, F.lit(following)).otherwise(out)
    return out


def circle_position(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """The circle's line counts as inside."""
    return F.when((x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius, F.lit(INSIDE)).otherwise(F.lit(OUTSIDE))


def sphere_position(lon: Column, lat: Column, clon: Column, clat: Column, metres: Column) -> Column:
    """Inside within a great-circle distance."""
    return F.when(distance_sphere(lon, lat, clon, clat) <= metres, F.lit(INSIDE)).otherwise(F.lit(OUTSIDE))


def all_not_outside(marks: Column) -> Column:
    return marks.bitwiseAND(F.lit(OUTSIDE)) == 0


def all_not_inside(marks: Column) -> Column:
    return marks.bitwiseAND(F.lit(INSIDE)) == 0


def wrap_longitude(lon: Column) -> Column:
    """Longitude within 180 degrees; what lies within stays, and turns around keep their far side."""
    return F.when(lon > 180.0, (lon + 180.0) % 360.0 - 180.0).when(lon < -180.0, 180.0 - (180.0 - lon) % 360.0).otherwise(lon)


def envelopes_overlap(w1: Column, e1: Column, s1: Column, n1: Column, w2: Column, e2: Column, s2: Column, n2: Column) -> Column:
    """Whether two lon/lat boxes meet; a box whose east is below its west crosses the antimeridian."""
    east1, east2 = F.when(e1 < w1, e1 + 360.0).otherwise(e1), F.when(e2 < w2, e2 + 360.0).otherwise(e2)
    meets = lambda shift: (w1 + shift <= east2) & (east1 + shift >= w2)
    return (s1 <= n2) & (n1 >= s2) & (meets(0.0) | meets(360.0) | meets(-360.0))


def holds_longitudes(west: Column, east: Column, other_west: Column, other_east: Column) -> Column:
    """Whether one range of longitudes holds another."""
    return (west <= other_west) & (east >= other_east)


def in_bounds(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a place is finite and within bounds, their edge included."""
    return F.coalesce(x.between(west, east) & y.between(south, north) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def liang_barsky(box: Box, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of a segment's start and end within a box, as struct<t0, t1>; null where none is."""
    dx, dy = x2 - x1, y2 - y1
    low, high, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for p, q in ((-dx, x1 - box.x1), (dx, box.x2 - x1), (-dy, y1 - box.y1), (dy, box.y2 - y1)):
        low.append(F.when(p < 0, q / p))
        high.append(F.when(p > 0, q / p))
        ok &= ~((p == 0) & (q < 0))
    t0, t1 = F.greatest(*low), F.least(*high)
    return F.when(ok & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def circle_hits(x1: Column, y1: Column, x2: Column, y2: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Shares of a segment at which it crosses a circle, in order; touching is no crossing."""
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - cx, y1 - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - radius * radius
    d = b * b - 4 * a * c
    roots = F.when((a > 0) & (d > 0), F.array((-b - F.sqrt(d)) / (2 * a), (-b + F.sqrt(d)) / (2 * a))).otherwise(F.array().cast("array<double>"))
    return F.filter(roots, lambda t: (t >= 0) & (t <= 1))
