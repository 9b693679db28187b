"""Geometry as a column.

A point is struct<x, y>; a ring or line is an array of points (rings repeat
their first point at the end); a polygon is an array of rings, the exterior
first. A geometry column holds lists of polygons, lines and points with the id
of its reference system. An empty geometry has three empty lists; null means
that there is no geometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
POLYGON = T.ArrayType(RING)
GEOMETRY = T.StructType([
    T.StructField("srid", T.IntegerType()),
    T.StructField("polys", T.ArrayType(POLYGON)),
    T.StructField("lines", T.ArrayType(RING)),
    T.StructField("points", T.ArrayType(POINT)),
])


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(srid: int = 4326, polys: Column | None = None, lines: Column | None = None, points: Column | None = None) -> Column:
    """A geometry of lists; those not given are empty."""
    parts = [(polys, T.ArrayType(POLYGON)), (lines, T.ArrayType(RING)), (points, T.ArrayType(POINT))]
    lists = [F.array().cast(kind) if c is None else F.coalesce(c.cast(kind), F.array().cast(kind)) for c, kind in parts]
    return F.struct(F.lit(srid).alias("srid"), *[c.alias(n) for c, n in zip(lists, ("polys", "lines", "points"), strict=True)])


def collected(polys: Column, lines: Column, points: Column, srid: int = 4326) -> Column:
    """Aggregate of pieces into one geometry: a line of one point becomes a point, lines without points go."""
    joined = F.flatten(F.collect_list(lines))
    single = F.transform(F.filter(joined, lambda p: F.size(p) == 1), lambda p: F.get(p, F.lit(0)))
    return geometry(srid, F.flatten(F.collect_list(polys)), F.filter(joined, lambda p: F.size(p) > 1), F.concat(F.flatten(F.collect_list(points)), single))


def geometry_type(geom: Column) -> Column:
    """Least type that holds a geometry's parts."""
    p, li, pt = (F.size(geom[n]) for n in ("polys", "lines", "points"))
    kinds = (p > 0).cast("int") + (li > 0).cast("int") + (pt > 0).cast("int")
    name = lambda n, one: F.when(n == 1, F.lit(one)).otherwise(F.lit(f"MULTI{one}"))
    return F.when(kinds != 1, F.lit("GEOMETRYCOLLECTION")).when(p > 0, name(p, "POLYGON")).when(li > 0, name(li, "LINESTRING")).otherwise(name(pt, "POINT"))


def vertex_table(df: DataFrame, key: str, polygon: str) -> DataFrame:
    """key, ring (0 is the exterior), idx, x and y of every vertex of a polygon column."""
    rings = df.select(key, F.posexplode(polygon).alias("ring", "points"))
    return rings.select(key, "ring", F.posexplode("points").alias("idx", "p")).select(key, "ring", "idx", "p.x", "p.y")


def rings_of(vertices: DataFrame, *keys: str) -> DataFrame:
    """Vertex tables back to rings: keys and points in the order of idx."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "x", "y")))
    return vertices.groupBy(*keys).agg(F.transform(rows, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"))).alias("points"))
