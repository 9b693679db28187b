"""Geometry operators on columns and tables that need sequential algorithms.

Each runs as an Arrow function over the geometry struct. ``clip`` and ``cut``
first settle, in expressions, rows whose envelope lies wholly on one side, so
only rows that cross a region reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from geolith import schema
from geolith.operators import paths, regions, triangulation

_ARROW = to_arrow_type(schema.GEOMETRY)


def plain(value: dict) -> regions.Geometry:
    """A geometry struct as plain lists; an Arrow dictionary has points as dictionaries."""
    pts = lambda ps: [(p["x"], p["y"]) for p in ps or []]
    return regions.Geometry([[pts(r) for r in poly] for poly in value["polys"] or []], [pts(r) for r in value["lines"] or []], pts(value["points"]))


def packed(geom: regions.Geometry, srid: int) -> dict:
    """Plain lists as a geometry struct; a line of one point becomes a point."""
    pts = lambda ps: [{"x": p[0], "y": p[1]} for p in ps]
    lines = [r for r in geom.lines if len(r) > 1]
    single = [r[0] for r in geom.lines if len(r) == 1]
    return {"srid": srid, "polys": [[pts(r) for r in poly] for poly in geom.polys], "lines": [pts(r) for r in lines], "points": pts([*geom.points, *single])}


def mapped(f: Callable[[regions.Geometry], regions.Geometry | None]) -> Callable[[Column], Column]:
    """A function of plain geometry as a column function; null stays null."""

    @arrow_udf(schema.GEOMETRY)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for value in column.to_pylist():
            made = None if value is None else f(plain(value))
            out.append(None if made is None else packed(made, value["srid"]))
        return pa.array(out, _ARROW)

    return run


def _vertices(geom: Column) -> Column:
    rings = F.concat(F.flatten(geom["polys"]), geom["lines"])
    return F.concat(F.flatten(rings), geom["points"])


def envelope(geom: Column) -> Column:
    """struct<west, east, south, north>; null of an empty geometry."""
    v = _vertices(geom)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.when(F.size(v) > 0, F.struct(F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.array_min(ys).alias("south"), F.array_max(ys).alias("north")))


def _part(geom: Column, region: regions.Region, inside: bool, keep_polygons: bool, step: float) -> Column:
    empty = schema.geometry()
    run = mapped(lambda g: regions.clip(g, region, inside, keep_polygons, step))
    if isinstance(region, regions.Sphere):
        return run(geom)
    box = envelope(geom)
    if isinstance(region, regions.Box):
        within = (box["west"] > region.x1) & (box["east"] < region.x2) & (box["south"] > region.y1) & (box["north"] < region.y2)
        apart = (box["west"] > region.x2) | (box["east"] < region.x1) | (box["south"] > region.y2) | (box["north"] < region.y1)
    else:
        far = lambda a, b, c: F.greatest(F.abs(box[a] - c), F.abs(box[b] - c))
        within = F.hypot(far("west", "east", region.x), far("south", "north", region.y)) < region.r
        apart = (box["west"] > region.x + region.r) | (box["east"] < region.x - region.r) | (box["south"] > region.y + region.r) | (box["north"] < region.y - region.r)
    untouched, gone = (within, apart) if inside else (apart, within)
    settled = F.when(geom.isNull() | box.isNull() | untouched, geom).when(gone, F.struct(geom["srid"].alias("srid"), *[empty[n].alias(n) for n in ("polys", "lines", "points")]))
    open_ = geom.isNotNull() & box.isNotNull() & ~untouched & ~gone
    return F.coalesce(settled, run(F.when(open_, geom)))


def polyclip(geom: Column, region: regions.Region, max_segment: float = 0.0) -> Column:
    """The part inside a region; polygons stay polygons. Segments along the region's edge are at most max_segment long."""
    return _part(geom, region, True, True, max_segment)


def polycut(geom: Column, region: regions.Region, max_segment: float = 0.0) -> Column:
    """The part outside a region; polygons stay polygons."""
    return _part(geom, region, False, True, max_segment)


def lineclip(geom: Column, region: regions.Region) -> Column:
    """The part inside a region; polygons that cross its edge become lines."""
    return _part(geom, region, True, False, 0.0)


def linecut(geom: Column, region: regions.Region) -> Column:
    """The part outside a region; polygons that cross its edge become lines."""
    return _part(geom, region, False, False, 0.0)


def area(geom: Column) -> Column:
    """Planar area of all polygons, holes taken off."""
    from geolith.functions.metrics import polygon_area

    return F.aggregate(geom["polys"], F.lit(0.0), lambda acc, p: acc + polygon_area(p))


def length(geom: Column) -> Column:
    """Planar length of all lines."""
    from geolith.functions.metrics import length_planar

    return F.aggregate(geom["lines"], F.lit(0.0), lambda acc, r: acc + length_planar(r))


def transform(geom: Column, projection: str, bounds: tuple[float, float, float, float], densify_km: float = 50.0, jump_km: float = 500.0, source: str | None = None) -> Column:
    """lon/lat geometry in a projection, without its seams and within bounds; geometry of another projected system (source) is moved vertex by vertex. Null where nothing is left."""
    from geolith.operators import project

    return mapped(lambda g: project.transform(g, projection, bounds, densify_km, jump_km, source))(geom)


def translated(geom: Column, dx: float, dy: float) -> Column:
    """Geometry moved by a distance."""
    return vertices_mapped(geom, lambda p: schema.point(p["x"] + dx, p["y"] + dy))


def vertices_mapped(geom: Column, f: Callable[[Column], Column]) -> Column:
    """Geometry with a function of points applied to every vertex."""
    path = lambda r: F.transform(r, f)
    polys = F.transform(geom["polys"], lambda p: F.transform(p, path))
    return F.when(geom.isNotNull(), F.struct(geom["srid"].alias("srid"), polys.alias("polys"), F.transform(geom["lines"], path).alias("lines"), path(geom["points"]).alias("points")))


def projected(geom: Column, projection: str, source: str | None = None) -> Column:
    """Every vertex in a projection, in expressions alone, without cuts; places it cannot show are null."""
    from geolith.functions import projections

    to = projections.forward(projection) if source is None else projections.between(source, projection)
    return vertices_mapped(geom, lambda p: schema.point(*to(p["x"], p["y"])))


def contains(geom: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in one of a geometry's polygons; lines and points hold nothing."""
    from geolith.functions.metrics import in_polygon

    return F.exists(geom["polys"], lambda p: in_polygon(p, x, y))


def fingerprint(geom: Column) -> Column:
    """A hash of a geometry's value."""
    return F.xxhash64(geom)


def disc(lon: Column, lat: Column, metres: Column, segments: int = 360) -> Column:
    """A disc on the globe as polygons between -180 and 180 degrees; one that holds a pole runs along it."""
    from geolith.operators import project

    @arrow_udf(schema.GEOMETRY)
    def run(x: pa.Array, y: pa.Array, r: pa.Array) -> pa.Array:
        rows = zip(x.to_pylist(), y.to_pylist(), r.to_pylist(), strict=True)
        return pa.array([None if None in row else packed(regions.Geometry(project.circle_parts(*row, segments), [], []), 4326) for row in rows], _ARROW)

    return run(lon.cast("double"), lat.cast("double"), metres.cast("double"))


def straight(geom: Column) -> Column:
    """Geometry whose polygons' rings have no vertex on the way from the last one kept to the next."""
    return mapped(lambda g: regions.Geometry([[paths.straightened(r) for r in p] for p in g.polys], g.lines, g.points))(geom)


def simple(geom: Column) -> Column:
    """Geometry whose polygons' rings meet no vertex twice: rings are cut there, and holes go to the ring that holds them."""
    def run(g: regions.Geometry) -> regions.Geometry:
        polys = []
        for p in g.polys:
            rings = [(k, s) for k, r in enumerate(p) for s in regions.simple_rings(r)]
            outer = [s if regions.signed_area(s) > 0 else s[::-1] for k, s in rings if k == 0]
            polys += regions.assembled([*outer, *(s if regions.signed_area(s) < 0 else s[::-1] for k, s in rings if k)])
        return regions.Geometry(polys, g.lines, g.points)

    return mapped(run)(geom)


def overlay(geom: Column, polygons: list[regions.Polygon], how: str) -> Column:
    """intersection, difference or union of a column's polygons with fixed ones; lines and points stay."""
    return mapped(lambda g: regions.Geometry(triangulation.overlay(g.polys, polygons, how), g.lines, g.points))(geom)


def expand(geom: Column, metres: float) -> Column:
    """lon/lat geometry widened by metres in world Mercator (EPSG 3395), exterior rings only: lines by the distance, points and polygons by twice it."""
    from geolith.functions.projections import forward_array, inverse_array

    world = "+proj=merc +datum=WGS84"
    to, back = forward_array(world), inverse_array(world)
    flat = lambda r: list(map(tuple, to(r).tolist()))

    def run(g: regions.Geometry) -> regions.Geometry:
        rings = [r for line in g.lines for r in triangulation.buffer(flat(line), metres)]
        rings += [r for p in g.points for r in triangulation.buffer(flat([p]), 2 * metres)]
        rings += [p[0] for poly in g.polys for p in triangulation.union([[flat(poly[0])], *[[r] for r in triangulation.buffer(flat(poly[0]), 2 * metres)]])]
        merged = triangulation.union([[r] for r in rings]) if len(rings) > 1 else [[r] for r in rings]
        return regions.Geometry([[list(map(tuple, back(poly[0]).tolist()))] for poly in merged], [], [])

    return mapped(run)(geom)


# -- sets of paths ------------------------------------------------------------

_PATH = "array<struct<x double, y double>>"
_PATH_ARROW = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _over_paths(f: Callable[[list, list], list]) -> Callable[[Column, Column], Column]:
    @arrow_udf(_PATH)
    def run(points: pa.Array, counts: pa.Array) -> pa.Array:
        out = [None if p is None else [{"x": a, "y": b} for a, b in f([(v["x"], v["y"]) for v in p], c)] for p, c in zip(points.to_pylist(), counts.to_pylist(), strict=True)]
        return pa.array(out, _PATH_ARROW)

    return run


def with_counts(rings: DataFrame, *keys: str, shared: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """rings (keys, points) with counts: how often each vertex stands in all rings (of its own set, where keys within name one), or 0 where that isn't asked. A closed ring's last vertex is its first."""
    if not shared:
        return rings.withColumn("counts", F.transform("points", lambda p: F.lit(0)))
    rows = rings.select(*keys, F.posexplode("points").alias("idx", "p"), F.size("points").alias("n"), (F.get("points", F.lit(0)) == F.element_at("points", -1)).alias("ring"))
    once = (~(F.col("ring") & (F.col("idx") == 0))).cast("int")
    counted = rows.withColumn("count", F.sum(once).over(W.partitionBy(*within, "p")).cast("int"))
    gathered = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "count"))).alias("c"))
    return rings.join(gathered.select(*keys, F.transform("c", lambda s: s["count"]).alias("counts")), list(keys))


def simplify(rings: DataFrame, tolerance: float, *keys: str, shared: bool = True) -> DataFrame:
    """Paths (keys, points) simplified by effective area. With shared, borders that two paths share stay shared, and other vertices stay."""
    run = _over_paths(lambda p, c: paths.simplify(p, tolerance, c))
    return with_counts(rings, *keys, shared=shared).withColumn("points", run("points", "counts")).drop("counts")


def smooth(rings: DataFrame, kind: str, radius: float, iterations: int, *keys: str, shared: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """Paths smoothed by weighted means of neighbours (average, linear, gaussian, tukey or taubin). within: keys of the set whose paths share borders; others' vertices at the same place do not count."""
    run = _over_paths(lambda p, c: paths.smooth(p, kind, radius, iterations, c))
    return with_counts(rings, *keys, shared=shared, within=within).withColumn("points", run("points", "counts")).drop("counts")


# -- amalgamation -------------------------------------------------------------

def amalgamate(polygons: DataFrame, key: str, gap: float, least_area: float = 0.0, mainland: float | None = None, least_total: float | None = None, close_bays: bool = False, parity: bool = False) -> DataFrame:
    """polygon and area of clusters joined across gaps. polygons: key (integer) and polygon.

    Polygons whose envelopes come within a gap form clusters; clusters whose
    total area is below least_total (by default least_area) go before any
    triangulation, and results below least_area after it. Single polygons pass
    through. Those of mainland size stand aside: they come back as they are, or
    with their own bays closed. Without a gap polygons are only filtered by area.
    parity: what lies within an even number of a cluster's rings is outside, also
    where polygons overlap.
    """
    from geolith.functions.metrics import envelope as ring_envelope, polygon_area
    from geolith.operators.joins import box_components

    rows = polygons.select(F.col(key).alias("key"), "polygon", polygon_area(F.col("polygon")).alias("area"))
    if gap <= 0:
        return rows.where(F.col("area") >= least_area).select("polygon", "area")
    aside = F.col("area") >= mainland if mainland else F.lit(False)
    small = rows.where(~aside).withColumn("box", ring_envelope(F.get("polygon", F.lit(0))))
    named = small.join(box_components(small.select("key", "box"), "key", gap, 4 * gap), "key")
    clusters = named.groupBy("component").agg(F.sum("area").alias("total"), F.collect_list("polygon").alias("polygons"))
    clusters = clusters.where(F.col("total") >= (least_area if least_total is None else least_total))

    kind = "array<array<array<struct<x double, y double>>>>"
    arrow = pa.list_(pa.list_(_PATH_ARROW))

    def joiner(alone: bool) -> Callable[[Column], Column]:
        @arrow_udf(kind)
        def joined(column: pa.Array) -> pa.Array:
            out = []
            for value in column.to_pylist():
                got = [[[(p["x"], p["y"]) for p in r] for r in poly] for poly in value]
                if alone or len(got) > 1:
                    got = triangulation.amalgamate(got, gap, least_area, parity)
                out.append([[[{"x": x, "y": y} for x, y in r] for r in poly] for poly in got])
            return pa.array(out, arrow)

        return joined

    made = clusters.select(F.explode(joiner(False)("polygons")).alias("polygon"))
    if mainland:
        large = rows.where(aside)
        made = made.unionByName(large.select(F.explode(joiner(True)(F.array("polygon"))).alias("polygon")) if close_bays else large.select("polygon"))
    return made.withColumn("area", polygon_area(F.col("polygon"))).where(F.col("area") >= least_area)
