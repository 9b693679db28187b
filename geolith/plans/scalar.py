"""Queries over single geometries: positions, metrics, text and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geolith.functions import crs, metrics, position, projections, text
from geolith.operators import project, spatial
from geolith.plans.fixtures import boxes, circles, points, square, stars, table, tiles, with_
from geolith.plans.registry import query
from geolith.schema import geometry, point, vertex_table

BOX = position.Box(-90.0, -45.0, 90.0, 45.0, 800, 600)
_KEYS = ("l_orderkey", "l_linenumber")
_POSITION = "CASE WHEN x < -90 OR x > 90 OR y < -45 OR y > 45 THEN 2 WHEN x = -90 OR x = 90 OR y = -45 OR y = 45 THEN (CASE WHEN x = -90 THEN 4 WHEN x = 90 THEN 16 ELSE 0 END) + (CASE WHEN y = -45 THEN 32 WHEN y = 45 THEN 8 ELSE 0 END) ELSE 1 END"


@query(with_("points") + "SELECT l_orderkey, l_linenumber, 'POINT (' || regexp_replace(printf('%.2f', x), '\\.?0+$', '') || ' ' || regexp_replace(printf('%.2f', y), '\\.?0+$', '') || ')' AS wkt FROM points")
def geom_wkt_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).select(*_KEYS, text.wkt_point(point(x, y), 2).alias("wkt"))


@query(with_("verts") + "SELECT vec_id, CAST(0 AS INT) AS ring, CAST(idx AS INT) AS idx, round(x, 6) AS x, round(y, 6) AS y FROM verts")
def ring_vertex_table(spark: SparkSession, sf: str) -> DataFrame:
    return vertex_table(stars(spark, sf), "vec_id", "polygon").select("vec_id", "ring", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_("points") + f"SELECT l_orderkey, l_linenumber, {_POSITION} AS position FROM points")
def box_position(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).select(*_KEYS, BOX.position(x, y).alias("position"))


@query(with_("points") + f"SELECT position, CAST(count(*) AS BIGINT) AS n, position > 2 AS on_edge, CASE position WHEN 4 THEN 8 WHEN 36 THEN 8 WHEN 8 THEN 16 WHEN 12 THEN 16 WHEN 16 THEN 32 WHEN 24 THEN 32 WHEN 32 THEN 4 WHEN 48 THEN 4 ELSE position END AS next_edge, (position & 4) > 0 AS same_edge_as_left FROM (SELECT {_POSITION} AS position FROM points) GROUP BY position")
def box_edge_helpers(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    p = F.col("position")
    counted = points(spark, sf).groupBy(BOX.position(x, y).alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(p, "n", position.on_edge(p).alias("on_edge"), position.next_edge(p).alias("next_edge"), position.on_same_edge(p, F.lit(position.LEFT)).alias("same_edge_as_left"))


@query(with_("verts") + f"SELECT vec_id, bit_or(position) AS marks, (bit_or(position) & 2) = 0 AS not_outside, (bit_or(position) & 1) = 0 AS not_inside FROM (SELECT vec_id, {_POSITION} AS position FROM verts) GROUP BY vec_id")
def position_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    marks = vertex_table(stars(spark, sf), "vec_id", "polygon").groupBy("vec_id").agg(F.bit_or(BOX.position(x, y)).alias("marks"))
    return marks.select("vec_id", "marks", position.all_not_outside(F.col("marks")).alias("not_outside"), position.all_not_inside(F.col("marks")).alias("not_inside"))


@query(with_("points") + "SELECT l_orderkey, l_linenumber, round((x + 90) * (800 / CAST(180 AS DOUBLE)), 6) AS px, round((45 - y) * (600 / CAST(90 AS DOUBLE)), 6) AS py FROM points")
def box_transform(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    px, py = BOX.to_pixel(x, y)
    return points(spark, sf).select(*_KEYS, F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(with_("points") + "SELECT l_orderkey, l_linenumber, round(x, 6) AS x, round(y, 6) AS y FROM points")
def box_itransform(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    px, py = BOX.to_pixel(x, y)
    back = points(spark, sf).select(*_KEYS, px.alias("px"), py.alias("py"))
    wx, wy = BOX.to_world(F.col("px"), F.col("py"))
    return back.select(*_KEYS, F.round(wx, 6).alias("x"), F.round(wy, 6).alias("y"))


@query(with_("tiles") + "SELECT n_nationkey, round(abs(CAST(72000 AS DOUBLE) / (100 + n_nationkey) * (CAST(34000 AS DOUBLE) / 100)) / 1000000, 9) AS km2 FROM tiles")
def area_factor(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(k, position.Box(0.0, 0.0, 72000.0, 34000.0, 100 + k, 100).pixel_area_km2()) for k in range(25)]
    factors = F.create_map(*[F.lit(v) for k, a in rows for v in (k, a)])
    return tiles(spark, sf).select("n_nationkey", F.round(F.try_element_at(factors, F.col("n_nationkey").cast("int")), 9).alias("km2"))


@query(with_("verts", "edges") + "SELECT vec_id, round(sum(x1 * y2 - x2 * y1) / 2, 6) AS area FROM edges GROUP BY vec_id")
def ring_area_planar(spark: SparkSession, sf: str) -> DataFrame:
    return stars(spark, sf).select("vec_id", F.round(metrics.signed_area(F.col("ring")), 6).alias("area"))


_SPHERE = "abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * (CAST(6378137 AS DOUBLE) * 6378137 / 2)"
_HAVERSINE = "2 * CAST(6378137 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
_STEP = _HAVERSINE.format(x1="x1", y1="y1", x2="x2", y2="y2")


@query(with_("verts", "edges") + f"SELECT vec_id, round({_SPHERE} / 1000000, 4) AS km2 FROM edges GROUP BY vec_id")
def ring_area_sphere(spark: SparkSession, sf: str) -> DataFrame:
    return stars(spark, sf).select("vec_id", F.round(metrics.area_sphere(F.col("ring")) / 1e6, 4).alias("km2"))


@query(with_("verts", "edges") + f"SELECT vec_id, round(sum({_STEP}), 3) AS metres, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS planar FROM edges GROUP BY vec_id")
def ring_length_sphere(spark: SparkSession, sf: str) -> DataFrame:
    return stars(spark, sf).select("vec_id", F.round(metrics.length_sphere(F.col("ring")), 3).alias("metres"), F.round(metrics.length_planar(F.col("ring")), 6).alias("planar"))


_AL = "abs(sum(x1 * y2 - x2 * y1)) / 2 AS a, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS l"


@query(with_("verts", "edges") + f"SELECT vec_id, round(4 * pi() * a / (l * l), 8) AS compactness FROM (SELECT vec_id, {_AL} FROM edges GROUP BY vec_id)")
def compactness_exterior(spark: SparkSession, sf: str) -> DataFrame:
    return stars(spark, sf).select("vec_id", F.round(metrics.compactness(F.col("polygon")), 8).alias("compactness"))


def _holed(spark: SparkSession, sf: str) -> DataFrame:
    """Part squares with a hole of half the side in the middle, wound clockwise."""
    hole = F.reverse(square(F.col("x0") + F.col("side") / 4, F.col("y0") + F.col("side") / 4, F.col("side") / 2))
    return boxes(spark, sf).select("p_partkey", "side", "x0", "y0", F.array(square(F.col("x0"), F.col("y0"), F.col("side")), hole).alias("polygon"))


@query(with_("boxes") + "SELECT p_partkey, CASE WHEN side > 0 THEN round(4 * pi() * (side * side - side * side / 4) / pow(6 * side, 2), 7) ELSE CAST(0 AS DOUBLE) END AS compactness, round(side * side * CAST(0.75 AS DOUBLE), 6) AS area FROM boxes")
def compactness_net(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("polygon")
    return _holed(spark, sf).select("p_partkey", F.round(metrics.compactness(p, net=True), 7).alias("compactness"), F.round(metrics.polygon_area(p), 6).alias("area"))


@query(with_("boxes") + "SELECT p_partkey, CAST(CASE WHEN round(side * side / 4, 6) >= 2 THEN 2 ELSE 1 END AS INT) AS rings FROM boxes WHERE round(side * side, 6) >= 2")
def despeckle(spark: SparkSession, sf: str) -> DataFrame:
    area = lambda r: F.round(metrics.area_planar(r), 6)
    kept = _holed(spark, sf).select("p_partkey", metrics.despeckle(F.col("polygon"), 2.0, area).alias("p"))
    return kept.where("p is not null").select("p_partkey", F.size("p").alias("rings"))


@query(with_("verts", "edges") + f"SELECT vec_id FROM (SELECT vec_id, {_AL} FROM edges GROUP BY vec_id) WHERE round(a, 6) >= 30 AND round(4 * pi() * a / (l * l), 8) >= CAST(0.04 AS DOUBLE)")
def compactness_filter(spark: SparkSession, sf: str) -> DataFrame:
    ring, polygon = F.col("ring"), F.col("polygon")
    return stars(spark, sf).where((F.round(metrics.area_planar(ring), 6) >= 30) & (F.round(metrics.compactness(polygon), 8) >= 0.04)).select("vec_id")


@query(with_("verts") + "SELECT vec_id, round(min(x), 6) AS west, round(max(x), 6) AS east, round(min(y), 6) AS south, round(max(y), 6) AS north FROM verts GROUP BY vec_id")
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    return stars(spark, sf).select("vec_id", *[F.round(F.col("box")[n], 6).alias(n) for n in ("west", "east", "south", "north")])


@query(with_("verts", "edges") + "SELECT vec_id, sum(x1 * y2 - x2 * y1) > 0 AS was_ccw, true AS ccw FROM edges GROUP BY vec_id")
def winding_normalize(spark: SparkSession, sf: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 2 == 0, F.reverse("ring")).otherwise(F.col("ring"))
    fixed = stars(spark, sf).select("vec_id", (metrics.signed_area(F.col("ring")) > 0).alias("was_ccw"), metrics.wound_polygon(F.array(turned)).alias("p"))
    return fixed.select("vec_id", "was_ccw", (metrics.signed_area(F.get("p", F.lit(0))) > 0).alias("ccw"))


@query(with_("verts") + "SELECT vec_id, round(min(x), 6) AS x, round(arg_min(y, {'x': x, 'y': y}), 6) AS y, CAST(65 AS INT) AS vertices FROM verts GROUP BY vec_id")
def ring_normalize(spark: SparkSession, sf: str) -> DataFrame:
    turned = stars(spark, sf).select("vec_id", metrics.from_smallest(F.col("ring")).alias("r"))
    first, last = F.get("r", F.lit(0)), F.element_at("r", -1)
    return turned.where(first == last).select("vec_id", F.round(first["x"], 6).alias("x"), F.round(first["y"], 6).alias("y"), F.size("r").alias("vertices"))


@query(with_("verts") + "SELECT vec_id, round(avg(x) + 10, 6) AS x, round(avg(y) - 5, 6) AS y FROM verts GROUP BY vec_id")
def translate(spark: SparkSession, sf: str) -> DataFrame:
    moved = stars(spark, sf).select("vec_id", spatial.translated(geometry(polys=F.array("polygon")), 10.0, -5.0).alias("g"))
    return vertex_table(moved.select("vec_id", F.get("g.polys", F.lit(0)).alias("polygon")), "vec_id", "polygon").groupBy("vec_id").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query(with_("verts") + "SELECT vec_id, round(min((x + 90) * (800 / CAST(180 AS DOUBLE))), 5) AS px, round(min((45 - y) * (600 / CAST(90 AS DOUBLE))), 5) AS py FROM verts GROUP BY vec_id")
def geometry_to_pixels(spark: SparkSession, sf: str) -> DataFrame:
    moved = stars(spark, sf).select("vec_id", F.transform("ring", lambda p: point(*BOX.to_pixel(p["x"], p["y"]))).alias("ring"))
    return moved.select("vec_id", *[F.round(metrics.envelope(F.col("ring"))[n], 5).alias(a) for n, a in (("west", "px"), ("south", "py"))])


@query("SELECT event_id, CASE WHEN lon > 180 THEN ((lon + 180) % 360) - 180 WHEN lon < -180 THEN -(((-lon + 180) % 360) - 180) ELSE lon END AS lon FROM (SELECT event_id, CAST((event_id * 7919) % 2881 - 1440 AS DOUBLE) / 2 AS lon FROM events)")
def modlon_wrap(spark: SparkSession, sf: str) -> DataFrame:
    lon = F.expr("CAST((event_id * 7919) % 2881 - 1440 AS DOUBLE) / 2")
    return table(spark, sf, "events").select("event_id", position.wrap_longitude(lon).alias("lon"))


@query(with_("verts") + "SELECT vec_id, CAST(count(*) AS BIGINT) AS n FROM verts GROUP BY vec_id")
def ring_autoclose(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get("ring", F.lit(0))
    ajar = F.concat(F.slice("ring", 1, 64), F.array(point(first["x"] + 1e-9, first["y"])))
    shut = stars(spark, sf).select("vec_id", metrics.closed(ajar).alias("ring"))
    return shut.where(F.get("ring", F.lit(0)) == F.element_at("ring", -1)).select("vec_id", F.size("ring").cast("long").alias("n"))


# -- clipping of points and segments ------------------------------------------

@query(with_("points") + "SELECT l_orderkey, l_linenumber FROM points WHERE x > -90 AND x < 90 AND y > -45 AND y < 45")
def point_clip_box(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).where(BOX.position(x, y) == position.INSIDE).select(*_KEYS)


@query(with_("points") + "SELECT l_orderkey, l_linenumber FROM points WHERE x < -90 OR x > 90 OR y < -45 OR y > 45")
def point_cut_box(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).where(BOX.position(x, y) == position.OUTSIDE).select(*_KEYS)


@query(with_("points") + "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN (x - 10) * (x - 10) + (y - 20) * (y - 20) <= 900 THEN 1 ELSE 2 END AS INT) AS position FROM points")
def point_clip_circle(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).select(*_KEYS, position.circle_position(x, y, F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("position"))


@query(with_("points") + f"SELECT l_orderkey, l_linenumber FROM points WHERE {_HAVERSINE.format(x1='x', y1='y', x2='CAST(25 AS DOUBLE)', y2='CAST(60 AS DOUBLE)')} <= 2000000")
def point_clip_sphere(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).where(position.sphere_position(x, y, F.lit(25.0), F.lit(60.0), F.lit(2e6)) == position.INSIDE).select(*_KEYS)


_LB = """SELECT vec_id, idx, round(x1 + t0 * (x2 - x1), 6) AS ax, round(y1 + t0 * (y2 - y1), 6) AS ay, round(x1 + t1 * (x2 - x1), 6) AS bx, round(y1 + t1 * (y2 - y1), 6) AS by FROM (
SELECT *, greatest(0, CASE WHEN x1 > x2 THEN (x1 - 90) / (x1 - x2) ELSE 0 END, CASE WHEN x2 > x1 THEN (-90 - x1) / (x2 - x1) ELSE 0 END, CASE WHEN y2 > y1 THEN (-45 - y1) / (y2 - y1) ELSE 0 END, CASE WHEN y1 > y2 THEN (y1 - 45) / (y1 - y2) ELSE 0 END) AS t0,
       least(1, CASE WHEN x1 > x2 THEN (x1 + 90) / (x1 - x2) ELSE 1 END, CASE WHEN x2 > x1 THEN (90 - x1) / (x2 - x1) ELSE 1 END, CASE WHEN y2 > y1 THEN (45 - y1) / (y2 - y1) ELSE 1 END, CASE WHEN y1 > y2 THEN (y1 + 45) / (y1 - y2) ELSE 1 END) AS t1 FROM edges) WHERE t0 <= t1"""


@query(with_("verts", "edges") + _LB)
def segment_clip_liang_barsky(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    t = position.liang_barsky(BOX, *map(F.col, ("x1", "y1", "x2", "y2")))
    cut = e.withColumn("t", t).where("t is not null")
    at = lambda n, k: F.round(F.col(f"{n}1") + F.col("t")[k] * (F.col(f"{n}2") - F.col(f"{n}1")), 6)
    return cut.select("vec_id", "idx", at("x", "t0").alias("ax"), at("y", "t0").alias("ay"), at("x", "t1").alias("bx"), at("y", "t1").alias("by"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    step = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.get("ring", i - 1).alias("a"), F.get("ring", i).alias("b")))
    rows = stars(spark, sf).select("vec_id", F.posexplode(step).alias("idx", "e"))
    return rows.select("vec_id", F.col("idx").cast("long").alias("idx"), F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


_HITS = """, q AS (SELECT vec_id, idx, pow(x2 - x1, 2) + pow(y2 - y1, 2) AS a, 2 * ((x1 - 10) * (x2 - x1) + (y1 - 20) * (y2 - y1)) AS b, pow(x1 - 10, 2) + pow(y1 - 20, 2) - 900 AS c FROM edges),
r AS (SELECT vec_id, idx, unnest([(-b - sqrt(b * b - 4 * a * c)) / (2 * a), (-b + sqrt(b * b - 4 * a * c)) / (2 * a)]) AS t FROM q WHERE a > 0 AND b * b - 4 * a * c > 0)
SELECT vec_id, idx, round(t, 6) AS t FROM r WHERE t >= 0 AND t <= 1"""


@query(with_("verts", "edges") + _HITS)
def segment_circle_intersection(spark: SparkSession, sf: str) -> DataFrame:
    hits = position.circle_hits(*map(F.col, ("x1", "y1", "x2", "y2")), F.lit(10.0), F.lit(20.0), F.lit(30.0))
    return _edges(spark, sf).select("vec_id", "idx", F.explode(hits).alias("t")).select("vec_id", "idx", F.round("t", 6).alias("t"))


# -- projections --------------------------------------------------------------

def _projected(spark: SparkSession, sf: str, string: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    px, py = projections.forward(string)(x, y)
    return points(spark, sf).select(*_KEYS, (F.round(px, 3) + F.lit(0.0)).alias("px"), (F.round(py, 3) + F.lit(0.0)).alias("py"))


def _sql(px: str, py: str, where: str = "true") -> str:
    return with_("points") + f", g AS (SELECT *, radians(y) AS p FROM points), h AS (SELECT *, {where} AS ok FROM g) SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN round({px}, 3) + 0 END AS px, CASE WHEN ok THEN round({py}, 3) + 0 END AS py FROM h"


_A = "CAST(6378137 AS DOUBLE)"


def _d(lon_0: int) -> str:
    return f"radians(CASE WHEN abs(x - {lon_0}) <= 180 THEN x - {lon_0} ELSE ((x - {lon_0} + 180) % 360 + 360) % 360 - 180 END)"


def _azimuthal(lon_0: int, lat_0: int) -> tuple[str, str, str]:
    s, c = f"sin(radians(CAST({lat_0} AS DOUBLE)))", f"cos(radians(CAST({lat_0} AS DOUBLE)))"
    return f"(cos(p) * sin({_d(lon_0)}))", f"({c} * sin(p) - {s} * cos(p) * cos({_d(lon_0)}))", f"({s} * sin(p) + {c} * cos(p) * cos({_d(lon_0)}))"


_E2 = "(CAST(2 AS DOUBLE) - 1 / CAST(298.257223563 AS DOUBLE)) / CAST(298.257223563 AS DOUBLE)"


@query(_sql(f"{_A} * {_d(0)}", f"{_A} * (ln((1 + sin(p)) / (1 - sin(p))) / 2 - sqrt({_E2}) / 2 * ln((1 + sqrt({_E2}) * sin(p)) / (1 - sqrt({_E2}) * sin(p))))"))
def proj_merc(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf, "+proj=merc +lon_0=0")


@query(_sql(f"{_A} * {_d(0)}", f"{_A} * ln(tan(pi() / 4 + p / 2))"))
def proj_webmerc(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf, "+proj=webmerc")


_e, _n, _c = _azimuthal(10, 52)


@query(_sql(f"{_A} * sqrt(2 / (1 + {_c})) * {_e}", f"{_A} * sqrt(2 / (1 + {_c})) * {_n}"))
def proj_laea(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf, "+proj=laea +lon_0=10 +lat_0=52 +R=6378137")


_S = f"sqrt({_e} * {_e} + {_n} * {_n})"


@query(_sql(f"{_A} * atan2({_S}, {_c}) / {_S} * {_e}", f"{_A} * atan2({_S}, {_c}) / {_S} * {_n}", f"{_S} > CAST(1e-12 AS DOUBLE)"))
def proj_aeqd_sphere(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf, "+proj=aeqd +lon_0=10E +lat_0=52N")


_pe, _pn, _pc = _azimuthal(20, 90)


@query(_sql(f"2 * {_A} / (1 + {_pc}) * {_pe} / 1000", f"2 * {_A} / (1 + {_pc}) * {_pn} / 1000", "y > -80"))
def proj_stere(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    px, py = projections.forward("+proj=stere +lat_0=90 +lon_0=20 +R=6378137")(x, y)
    return points(spark, sf).select(*_KEYS, *[F.when(y > -80, F.round(c / 1000, 3) + F.lit(0.0)).alias(n) for c, n in ((px, "px"), (py, "py"))])


_T = "tan(pi() / 4 + radians(CAST({} AS DOUBLE)) / 2)"
_N = f"(ln(cos(radians(CAST(33 AS DOUBLE))) / cos(radians(CAST(45 AS DOUBLE)))) / ln({_T.format(45)} / {_T.format(33)}))"
_FF = f"({_A} * cos(radians(CAST(33 AS DOUBLE))) * pow({_T.format(33)}, {_N}) / {_N})"
_RHO = f"({_FF} / pow(tan(pi() / 4 + p / 2), {_N}))"


@query(_sql(f"{_RHO} * sin({_N} * {_d(-96)}) / 1000", f"({_FF} / pow({_T.format(39)}, {_N}) - {_RHO} * cos({_N} * {_d(-96)})) / 1000"))
def proj_lcc(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    px, py = projections.forward("+proj=lcc +lon_0=-96 +lat_0=39 +lat_1=33 +lat_2=45 +R=6378137")(x, y)
    return points(spark, sf).select(*_KEYS, F.round(px / 1000, 3).alias("px"), F.round(py / 1000, 3).alias("py"))


@query(_sql(f"{_A} * cos(radians(CAST(30 AS DOUBLE))) * {_d(0)}", f"{_A} * p"))
def proj_eqc(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf, "+proj=eqc +lat_ts=30")


@query(_sql(f"{_A} * {_e}", f"{_A} * {_n}", f"{_c} >= 0"))
def proj_ortho(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf, "+proj=ortho +lon_0=10 +lat_0=52")


@query(_sql(f"{_A} * {_e} / {_c} / 1000", f"{_A} * {_n} / {_c} / 1000", f"{_c} > CAST(0.01 AS DOUBLE)"))
def proj_gnom(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    px, py = projections.forward("+proj=gnom +lon_0=10 +lat_0=52")(x, y)
    near = F.sin(F.radians(F.lit(52.0))) * F.sin(F.radians(y)) + F.cos(F.radians(F.lit(52.0))) * F.cos(F.radians(y)) * F.cos(F.radians(x - 10.0)) > 0.01
    return points(spark, sf).select(*_KEYS, F.when(near, F.round(px / 1000, 3)).alias("px"), F.when(near, F.round(py / 1000, 3)).alias("py"))


@query(_sql(f"{_A} * {_d(15)} * cos(p)", f"{_A} * p"))
def proj_sinu(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf, "+proj=sinu +lon_0=15")


@query(_sql("(degrees(atan2(cos(p) * sin(radians(x)), sin(radians(CAST(30 AS DOUBLE))) * cos(p) * cos(radians(x)) + cos(radians(CAST(30 AS DOUBLE))) * sin(p))))", "degrees(asin(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), sin(radians(CAST(30 AS DOUBLE))) * sin(p) - cos(radians(CAST(30 AS DOUBLE))) * cos(p) * cos(radians(x))))))", "abs(x) < 180 AND x <> 0"))
def proj_ob_tran(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    ok = (F.abs(x) < 180) & (x != 0)
    px, py = projections.forward("+proj=ob_tran +o_proj=longlat +o_lat_p=30 +lon_0=0")(x, y)
    return points(spark, sf).select(*_KEYS, F.when(ok, F.round(px, 3)).alias("px"), F.when(ok, F.round(py, 3)).alias("py"))


@query(_sql("CAST(x * 0 AS DOUBLE)", "CAST(0 AS DOUBLE)").replace("AS px", "AS dx").replace("AS py", "AS dy"))
def proj_moll(spark: SparkSession, sf: str) -> DataFrame:
    """Residual of the auxiliary angle's equation, and of longitude, after the projection: zero."""
    x, y = F.col("x"), F.col("y")
    px, py = projections.forward("+proj=moll")(x, y)
    theta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), py / (projections.A * 2**0.5))))
    import math

    off = (2 * theta + F.sin(2 * theta)) - math.pi * F.sin(F.radians(y))
    back = px * math.pi / (2 * 2**0.5 * projections.A * F.cos(theta)) - F.radians(x)
    zero = lambda c: F.when(F.abs(c) < 1e-5, F.lit(0.0)).otherwise(c)
    return points(spark, sf).select(*_KEYS, zero(back).alias("dx"), zero(off).alias("dy"))


@query(with_("points") + ", g AS (SELECT *, radians(y) AS p FROM points), s AS (SELECT l_orderkey, l_linenumber, y, x + 0 AS lon FROM g) SELECT l_orderkey, l_linenumber, round(degrees(atan2(0 - radians(lon - 20) * 0, CAST(1 AS DOUBLE))), 3) AS merc, round(((lon - 20 + 180) % 360 + 360) % 360 - 180, 2) AS polar FROM s")
def grid_north(spark: SparkSession, sf: str) -> DataFrame:
    """Azimuth of grid north: nil in Mercator, and the longitude from the centre in a polar view."""
    x, y = F.col("x"), F.col("y")
    merc = projections.grid_north(projections.forward("+proj=merc"), x, y)
    polar = -projections.grid_north(projections.forward("+proj=stere +lat_0=90 +lon_0=20"), x, y)
    turned = F.round(polar, 2)
    return points(spark, sf).select(*_KEYS, F.round(F.abs(merc), 3).alias("merc"), F.when(turned == 180, F.lit(-180.0)).otherwise(turned).alias("polar"))


@query("SELECT s_suppkey, 'stere' AS proj, CAST(60 + s_suppkey % 7 AS DOUBLE) AS lat_ts, -CAST(s_suppkey % 90 AS DOUBLE) AS lon_0, true AS no_defs FROM supplier")
def proj_string_parse(spark: SparkSession, sf: str) -> DataFrame:
    string = F.format_string("+proj=stere +lat_ts=%dN +lon_0=%dW +no_defs", 60 + F.col("s_suppkey") % 7, F.col("s_suppkey") % 90)
    got = text.projection_parameters(string)
    rows = table(spark, sf, "supplier").select("s_suppkey", got.alias("m"))
    return rows.select("s_suppkey", F.col("m")["proj"].alias("proj"), text.signed_degrees(F.col("m")["lat_ts"]).alias("lat_ts"), text.signed_degrees(F.col("m")["lon_0"]).alias("lon_0"), F.map_contains_key("m", "no_defs").alias("no_defs"))


_MERC_Y = f"{_A} * (ln((1 + sin(radians({{lat}}))) / (1 - sin(radians({{lat}})))) / 2 - sqrt({_E2}) / 2 * ln((1 + sqrt({_E2}) * sin(radians({{lat}}))) / (1 - sqrt({_E2}) * sin(radians({{lat}})))))"
_LAT = "2 * atan(exp({y} / CAST(6378137 AS DOUBLE))) - pi() / 2"


@query(with_("circles") + f""", o AS (SELECT s_suppkey, {_A} * radians(cx) AS x0, {_MERC_Y.format(lat="cy")} AS y0 FROM circles WHERE abs(cy) < 60 AND abs(cx) < 170),
v AS (SELECT s_suppkey, k, x0 + 20000 * cos(2 * pi() * k / 80) AS x, y0 + 20000 * sin(2 * pi() * k / 80) AS y FROM o, (SELECT unnest(range(0, 81)) AS k)),
s0 AS (SELECT s_suppkey, k, degrees(x / {_A}) AS lon, y / {_A} AS psi, tanh(y / {_A}) AS s FROM v),
""" + ", ".join(f"s{i} AS (SELECT s_suppkey, k, lon, psi, tanh(psi + sqrt({_E2}) / 2 * ln((1 + sqrt({_E2}) * s) / (1 - sqrt({_E2}) * s))) AS s FROM s{i - 1})" for i in range(1, 7)) + """,
e AS (SELECT s_suppkey, k, lon, degrees(asin(s)) AS lat, lead(lon) OVER w AS lon2, lead(degrees(asin(s))) OVER w AS lat2 FROM s6 WINDOW w AS (PARTITION BY s_suppkey ORDER BY k))
SELECT s_suppkey, round(sum(lon * lat2 - lon2 * lat) / 2, 6) AS area FROM e WHERE lon2 IS NOT NULL GROUP BY s_suppkey""")
def buffer_point(spark: SparkSession, sf: str) -> DataFrame:
    """Points widened by metres in world Mercator: twice the distance, eighty corners."""
    near = circles(spark, sf).where("abs(cy) < 60 and abs(cx) < 170")
    wide = spatial.expand(geometry(points=F.array(point(F.col("cx"), F.col("cy")))), 10_000.0)
    return near.select("s_suppkey", F.round(spatial.area(wide), 6).alias("area"))


@query(with_("circles") + """, g AS (SELECT s_suppkey, k, cx, radians(cy) AS p, radians(r) AS d, 2 * pi() * k / 24 AS b FROM circles, (SELECT unnest(range(0, 25)) AS k) WHERE abs(cy) + r < 89),
h AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS q FROM g), v AS (SELECT s_suppkey, k, cx + degrees(atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))) AS x, degrees(q) AS y FROM h),
e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(x) OVER (PARTITION BY s_suppkey) > 180 OR min(x) OVER (PARTITION BY s_suppkey) < -180 AS over FROM v WINDOW w AS (PARTITION BY s_suppkey ORDER BY k))
SELECT s_suppkey, round(abs(sum(x * y2 - x2 * y)) / 2, 5) AS area, CAST(CASE WHEN bool_or(over) THEN 2 ELSE 1 END AS INT) AS parts FROM e WHERE x2 IS NOT NULL GROUP BY s_suppkey""")
def geodesic_circle(spark: SparkSession, sf: str) -> DataFrame:
    """Discs on the globe, cut at the antimeridian."""
    import math

    rows = circles(spark, sf).where("abs(cy) + r < 89").select("s_suppkey", spatial.disc(F.col("cx"), F.col("cy"), F.col("r") * (math.pi / 180 * 6378137.0), 24).alias("g"))
    return rows.select("s_suppkey", F.round(spatial.area(F.col("g")), 5).alias("area"), F.size("g.polys").alias("parts"))


@query("""WITH g AS (SELECT k, i, radians(CAST(85 AS DOUBLE)) AS p, radians(CAST(k AS DOUBLE)) AS d, 2 * pi() * i / 72 AS b FROM (SELECT unnest(range(6, 15)) AS k), (SELECT unnest(range(0, 73)) AS i)),
h AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS q FROM g), v AS (SELECT k, i, degrees(atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))) AS x, degrees(q) AS y FROM h),
w AS (SELECT k, i, x, y FROM v UNION ALL SELECT k, 73, x, 90 FROM v WHERE i = 72 UNION ALL SELECT k, 74, x, 90 FROM v WHERE i = 0 UNION ALL SELECT k, 75, x, y FROM v WHERE i = 0),
e AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)) SELECT k, round(abs(sum(x * y2 - x2 * y)) / 2, 3) AS area FROM e WHERE x2 IS NOT NULL GROUP BY k""")
def geodesic_circle_pole(spark: SparkSession, sf: str) -> DataFrame:
    """Discs that hold the pole: they run along it."""
    import math

    rows = spark.range(6, 15).select(F.col("id").alias("k"), spatial.disc(F.lit(0.0), F.lit(85.0), F.col("id") * (math.pi / 180 * 6378137.0), 72).alias("g"))
    return rows.select("k", F.round(spatial.area(F.col("g")), 3).alias("area"))


@query(with_("boxes") + "SELECT p_partkey, 'M' || a || ' ' || d || ' ' || b || ' ' || d || ' ' || b || ' ' || c || ' ' || a || ' ' || c || 'Z' AS svg FROM (SELECT p_partkey, regexp_replace(printf('%.1f', x0), '\\.?0+$', '') AS a, regexp_replace(printf('%.1f', x0 + side + 1), '\\.?0+$', '') AS b, regexp_replace(printf('%.1f', 1000 - y0 - side - 1), '\\.?0+$', '') AS c, regexp_replace(printf('%.1f', 1000 - y0), '\\.?0+$', '') AS d FROM boxes)")
def svg_path(spark: SparkSession, sf: str) -> DataFrame:
    page = position.Box(0.0, 0.0, 1000.0, 1000.0, 1000, 1000)
    return boxes(spark, sf).select("p_partkey", text.svg_polygon(F.array(square(F.col("x0"), F.col("y0"), F.col("side") + 1.0)), page, 1).alias("svg"))


# -- projections on the ellipsoid ----------------------------------------------

def _number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _psi(phi: str, e: float) -> str:
    """Ordinate of Mercator on a unit ellipsoid, in SQL."""
    return f"(ln((1 + sin({phi})) / (1 - sin({phi}))) / 2 - {_number(e / 2)} * ln((1 + {_number(e)} * sin({phi})) / (1 - {_number(e)} * sin({phi}))))"


def _kilometres(spark: SparkSession, sf: str, string: str, where: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    px, py = projections.forward(string)(x, y)
    return points(spark, sf).where(where).select(*_KEYS, F.round(px / 1000, 4).alias("px"), F.round(py / 1000, 4).alias("py"))


_WGS = projections.projection("+proj=longlat").given.earth
_ZONE = projections._krueger(_WGS)
_SUM = lambda f, g, v: " + ".join(f"{_number(c)} * {f}({2 * (j + 1)} * xi) * {g}({2 * (j + 1)} * eta)" for j, c in enumerate(_ZONE.forth))


@query(with_("points") + f""", a AS (SELECT l_orderkey, l_linenumber, radians(x - 27) AS l, sinh({_psi("radians(y)", _WGS.e)}) AS t FROM points WHERE x BETWEEN 0 AND 54),
b AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM a)
SELECT l_orderkey, l_linenumber, round((500000 + {_number(0.9996 * _ZONE.radius)} * (eta + {_SUM("cos", "sinh", 0)})) / 1000, 4) AS px, round({_number(0.9996 * _ZONE.radius)} * (xi + {_SUM("sin", "cosh", 0)}) / 1000, 4) AS py FROM b""")
def proj_utm(spark: SparkSession, sf: str) -> DataFrame:
    """Transverse Mercator on the ellipsoid, up to 27 degrees from its meridian."""
    return _kilometres(spark, sf, "+proj=utm +zone=35 +datum=WGS84", "x between 0 and 54")


_EUROPE = projections.projection(crs.projection(3035)).given.earth
_Q = lambda p: f"({_number(1 - _EUROPE.e2)} * (sin({p}) / (1 - {_number(_EUROPE.e2)} * pow(sin({p}), 2)) + ln((1 + {_number(_EUROPE.e)} * sin({p})) / (1 - {_number(_EUROPE.e)} * sin({p}))) / {_number(2 * _EUROPE.e)}))"


@query(with_("points") + f""", c AS (SELECT {_Q("(pi() / 2)")} AS qp, {_Q("radians(CAST(52 AS DOUBLE))")} AS q0, cos(radians(CAST(52 AS DOUBLE))) / sqrt(1 - {_number(_EUROPE.e2)} * pow(sin(radians(CAST(52 AS DOUBLE))), 2)) AS m0),
d AS (SELECT asin(q0 / qp) AS b0, {_number(_EUROPE.a)} * sqrt(qp / 2) AS r, qp, m0 FROM c),
f AS (SELECT l_orderkey, l_linenumber, radians(x - 10) AS l, asin({_Q("radians(y)")} / qp) AS b, b0, r, {_number(_EUROPE.a)} * m0 / (r * cos(b0)) AS w FROM points, d WHERE x BETWEEN -80 AND 100),
g AS (SELECT *, r * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(l))) AS k FROM f)
SELECT l_orderkey, l_linenumber, round((4321000 + k * w * cos(b) * sin(l)) / 1000, 4) AS px, round((3210000 + k / w * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(l))) / 1000, 4) AS py FROM g""")
def proj_laea_europe(spark: SparkSession, sf: str) -> DataFrame:
    return _kilometres(spark, sf, crs.projection(3035), "x between -80 and 100")


@query(with_("points") + f", a AS (SELECT l_orderkey, l_linenumber, radians(x) AS l, {_number(2 * _WGS.a * 0.994 / ((1 + _WGS.e) ** (1 + _WGS.e) * (1 - _WGS.e) ** (1 - _WGS.e)) ** 0.5)} * exp(-{_psi('radians(y)', _WGS.e)}) AS rho FROM points WHERE y > 0) SELECT l_orderkey, l_linenumber, round((2000000 + rho * sin(l)) / 1000, 4) AS px, round((2000000 - rho * cos(l)) / 1000, 4) AS py FROM a")
def proj_ups(spark: SparkSession, sf: str) -> DataFrame:
    """The polar stereographic system of the north."""
    return _kilometres(spark, sf, crs.projection(32661), "y > 0")


_M = lambda d: f"(cos(radians(CAST({d} AS DOUBLE))) / sqrt(1 - {_number(_WGS.e2)} * pow(sin(radians(CAST({d} AS DOUBLE))), 2)))"
_P = lambda d: _psi(f"radians(CAST({d} AS DOUBLE))", _WGS.e)


@query(with_("points") + f""", c AS (SELECT ln({_M(33)} / {_M(45)}) / ({_P(45)} - {_P(33)}) AS n), k AS (SELECT n, {_number(_WGS.a)} * {_M(33)} * exp(n * {_P(33)}) / n AS f FROM c),
a AS (SELECT l_orderkey, l_linenumber, n, f, f * exp(-n * {_psi("radians(y)", _WGS.e)}) AS rho, radians(CASE WHEN x + 96 <= 180 THEN x + 96 ELSE x - 264 END) AS l FROM points, k)
SELECT l_orderkey, l_linenumber, round(rho * sin(n * l) / 1000, 4) AS px, round((f * exp(-n * {_P(39)}) - rho * cos(n * l)) / 1000, 4) AS py FROM a""")
def proj_lcc_ellipsoid(spark: SparkSession, sf: str) -> DataFrame:
    return _kilometres(spark, sf, "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96 +datum=WGS84", "true")


@query(with_("points") + "SELECT l_orderkey, l_linenumber, round(x, 5) AS merc_x, round(y, 5) AS merc_y, round(x, 5) AS lcc_x, round(y, 5) AS lcc_y, round(x, 5) AS laea_x, round(y, 5) AS laea_y, round(x, 5) AS utm_x, round(y, 5) AS utm_y FROM points WHERE x BETWEEN 0 AND 54")
def proj_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """There and back again."""
    strings = {"merc": "+proj=merc", "lcc": "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96", "laea": crs.projection(3035), "utm": "+proj=utm +zone=35"}
    x, y = F.col("x"), F.col("y")
    there = points(spark, sf).where("x between 0 and 54").select(*_KEYS, *[c.alias(f"{k}_{n}_") for k, v in strings.items() for c, n in zip(projections.forward(v)(x, y), "xy", strict=True)])
    back = {k: projections.inverse(v)(F.col(f"{k}_x_"), F.col(f"{k}_y_")) for k, v in strings.items()}
    return there.select(*_KEYS, *[F.round(c, 5).alias(f"{k}_{n}") for k, both in back.items() for c, n in zip(both, "xy", strict=True)])


# -- reference systems ------------------------------------------------------------

def _values(rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


_SEEDS = f"""system(srid, name, proj, deprecated, kind) AS (VALUES {_values([(c, n, p, d, "geodetic" if crs.is_geographic(p) else "projected") for c, n, p, d, _ in crs.systems()])}),
used(srid, place, extent, scope) AS (VALUES {_values([(c, k, e, s) for c, _, _, _, u in crs.systems() for k, (e, s) in enumerate(u)])}),
extent(extent, west, east, south, north) AS (VALUES {_values([(k, *v) for k, v in crs.extents().items()])}),
scope(scope, said) AS (VALUES {_values(list(crs.SCOPES.items()))})"""


@query(f"WITH {_SEEDS}, r AS (SELECT *, (CASE WHEN east < west THEN east + 360 ELSE east END - west) * (north - south) AS area, row_number() OVER (PARTITION BY system.srid ORDER BY (CASE WHEN east < west THEN east + 360 ELSE east END - west) * (north - south) DESC, place) AS k FROM system JOIN used ON system.srid = used.srid JOIN extent ON extent.extent = used.extent JOIN scope ON scope.scope = used.scope) SELECT srid, name, west, east, south, north, said AS scope, area FROM r WHERE k = 1")
def epsg_join_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Systems joined with usages, extents and scopes; the largest extent of each."""
    return crs.information(**crs.tables(spark)).select("srid", "name", "west", "east", "south", "north", "scope", "area")


@query("SELECT s_suppkey, CAST(32590 + s_suppkey % 90 AS INT) AS srid FROM supplier WHERE s_suppkey % 90 BETWEEN 11 AND 70 OR s_suppkey % 90 = 71")
def crs_known_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose code is a known system."""
    rows = table(spark, sf, "supplier").select("s_suppkey", (32590 + F.col("s_suppkey") % 90).cast("int").alias("srid"))
    return crs.known(rows, spark).select("s_suppkey", "srid")


@query("""WITH z AS (SELECT unnest(range(1, 61)) AS z) SELECT CAST(32600 + z AS INT) AS srid, CAST(32600 + z AS INT) AS epsg, 'PROJCS["WGS 84 / UTM zone ' || z || 'N",' || g || ',AUTHORITY["EPSG","' || (32600 + z) || '"]]' AS wkt, 'PROJCS["WGS 84 / UTM zone ' || z || 'N",' || replace(g, ',AXIS["Easting",EAST],AXIS["Northing",NORTH]', '') || ']' AS simple_wkt, '+proj=utm +zone=' || z || ' +datum=WGS84 +units=m +no_defs' AS proj
FROM (SELECT z, 'GEOGCS["WGS 84",DATUM["WGS84",SPHEROID["WGS84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",' || (6 * z - 183) || '],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AXIS["Easting",EAST],AXIS["Northing",NORTH]' AS g FROM z)""")
def srs_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Well-known text, plain and simple, and strings of the northern zones; the code read back from the text."""
    return crs.texts(spark).where("srid between 32601 and 32660").select("srid", "epsg", "wkt", "simple_wkt", "proj")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_suppkey % 50 AS DOUBLE) - 180 END AS west, CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_suppkey % 50 AS DOUBLE) + 180 END AS east FROM supplier WHERE s_suppkey < 150")
def interrupt_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """What projections show before they wrap: straight ones and longitudes around their middle, others no box."""
    names = ("+proj=merc +lon_0=", "+proj=longlat +lon_wrap=", "+proj=laea +lon_0=")
    boxes_ = [(k, project.envelope(f"{names[k % 3]}{k % 50}")) for k in range(150)]
    shown = spark.createDataFrame([(k, *(b[:2] if b else (None, None))) for k, b in boxes_], "s_suppkey long, west double, east double")
    return table(spark, sf, "supplier").select("s_suppkey").join(shown, "s_suppkey")


# -- smaller predicates and lengths ------------------------------------------------

@query(with_("shores") + "SELECT o_orderkey FROM shores WHERE west <= -20 AND east >= -20 OR (west <= 100 AND east >= 101)")
def longitude_containment(spark: SparkSession, sf: str) -> DataFrame:
    from geolith.plans.fixtures import shores

    at = lambda a, b: position.holds_longitudes(F.col("west"), F.col("east"), F.lit(a), F.lit(b))
    return shores(spark, sf).where(at(-20.0, -20.0) | at(100.0, 101.0)).select("o_orderkey")


@query(with_("points") + "SELECT l_orderkey, l_linenumber FROM points WHERE x >= -33.5 AND x <= 77.25 AND y >= -10 AND y <= 60.5")
def projected_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).where(position.in_bounds(F.col("x"), F.col("y"), -33.5, -10.0, 77.25, 60.5)).select(*_KEYS)


@query("SELECT s_suppkey, round((1 + s_suppkey % 40) * CAST(180 AS DOUBLE) / 800, 9) AS radius FROM supplier")
def pixel_radius(spark: SparkSession, sf: str) -> DataFrame:
    """A radius in pixels of a viewport, in its world units."""
    return table(spark, sf, "supplier").select("s_suppkey", F.round(BOX.pixel_length(1 + F.col("s_suppkey") % 40), 9).alias("radius"))


@query(with_("boxes") + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT (x0, y0, side)) AS BIGINT) AS kinds FROM boxes")
def geometry_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Equal geometries have equal hashes, and others have others."""
    shape = geometry(polys=F.array(F.array(square(F.col("x0"), F.col("y0"), F.col("side")))))
    return boxes(spark, sf).select(spatial.fingerprint(shape).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("kinds"))


@query(with_("boxes") + "SELECT p_partkey, CAST(CASE WHEN round(side * side, 6) >= 4 THEN 1 ELSE 0 END AS INT) AS polys, CAST(1 + CASE WHEN round(side * side / 4, 6) >= 4 THEN 1 ELSE 0 END AS INT) AS lines, CAST(1 AS INT) AS points FROM boxes")
def despeckle_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons and closed lines below an area go; open lines and points stay."""
    x0, y0, side = F.col("x0"), F.col("y0"), F.col("side")
    whole = geometry(polys=F.array(F.array(square(x0, y0, side))), lines=F.array(square(x0, y0, side / 2), F.array(point(x0, y0), point(x0 + 1.0, y0))), points=F.array(point(x0, y0)))
    kept = boxes(spark, sf).select("p_partkey", metrics.despeckle_geometry(whole, 4.0, lambda r: F.round(metrics.area_planar(r), 6)).alias("g"))
    return kept.select("p_partkey", *[F.size(f"g.{n}").alias(n) for n in ("polys", "lines", "points")])


@query(with_("points", "verts", "edges") + ", pt AS (SELECT row_number() OVER () AS r, * FROM points WHERE l_linenumber = 1), h AS (SELECT p.r, e.vec_id FROM pt p JOIN edges e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 WHERE e.vec_id IN (7, 108) GROUP BY p.r, e.vec_id HAVING count(*) % 2 = 1), k AS (SELECT DISTINCT r FROM h) SELECT k.r IS NOT NULL AS held, CAST(count(*) AS BIGINT) AS n FROM pt LEFT JOIN k ON pt.r = k.r GROUP BY 1")
def point_in_multipolygon(spark: SparkSession, sf: str) -> DataFrame:
    """How many points lie in any polygon of one geometry."""
    shape = stars(spark, sf).where("vec_id in (7, 108)").agg(geometry(polys=F.collect_list("polygon")).alias("g"))
    held = spatial.contains(F.col("g"), F.col("x"), F.col("y"))
    return points(spark, sf).where("l_linenumber = 1").join(F.broadcast(shape)).groupBy(held.alias("held")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, CAST(2 AS INT) AS rings, round(CAST(5 AS DOUBLE), 6) AS area FROM supplier")
def figure_eight(spark: SparkSession, sf: str) -> DataFrame:
    """A ring that meets one of its vertices again, cut into simple ones."""
    k = (F.col("s_suppkey") % 100).cast("double")
    at = lambda x, y: point(k + float(x), F.lit(float(y)))
    ring = F.array(*[at(*p) for p in ((0, 0), (1, 0), (1, 1), (3, 1), (3, 3), (1, 3), (1, 1), (0, 1), (0, 0))])
    out = table(spark, sf, "supplier").select("s_suppkey", spatial.simple(geometry(polys=F.array(F.array(ring)))).alias("g"))
    return out.select("s_suppkey", F.size("g.polys").alias("rings"), F.round(spatial.area(F.col("g")), 6).alias("area"))


@query(f"WITH {_SEEDS} SELECT srid, 'EPSG:' || srid || ' ' || name || printf(' [%.2f,%.2f,%.2f,%.2f]', west, south, east, north) AS said FROM system JOIN used USING (srid) JOIN extent ON used.extent = extent.extent WHERE srid BETWEEN 32601 AND 32760 AND srid <> 32661")
def crs_described(spark: SparkSession, sf: str) -> DataFrame:
    """A line about each zone."""
    rows = crs.table(spark).where("srid between 32601 and 32760 and srid <> 32661")
    return rows.select("srid", crs.described(*map(F.col, ("srid", "name", "west", "east", "south", "north", "deprecated"))).alias("said"))


@query(with_("circles") + "SELECT s_suppkey, 'M' || a || ' ' || b || ' ' || c || ' ' || d AS svg FROM (SELECT s_suppkey, " + ", ".join(f"CASE WHEN {t} = '-0' THEN '0' ELSE {t} END AS {n}" for n, t in ((n, f"regexp_replace(printf('%.1f', {e}), '\\.?0+$', '')") for n, e in (("a", "cx + CAST(0.013 AS DOUBLE)"), ("b", "cy + CAST(0.013 AS DOUBLE)"), ("c", "cx + CAST(0.013 AS DOUBLE) + r"), ("d", "cy + CAST(0.013 AS DOUBLE) - r")))) + " FROM circles)")
def svg_line_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without a viewport, in the usual decimals."""
    cx, cy, r = F.col("cx") + 0.013, F.col("cy") + 0.013, F.col("r")
    return circles(spark, sf).select("s_suppkey", text.svg_line(F.array(point(cx, cy), point(cx + r, cy - r))).alias("svg"))


@query("SELECT CAST(count(*) AS INT) AS n, 'MULTIPOINT' AS type, round(sum(c_custkey % 170), 6) AS x FROM customer WHERE c_nationkey < 3 AND c_custkey % 5 > 0")
def feature_collection(spark: SparkSession, sf: str) -> DataFrame:
    """All geometries of a filtered layer side by side in one; missing ones go."""
    from geolith.schema import geometry_type
    from geolith.sources.features import geometry_collection

    place = geometry(points=F.array(point((F.col("c_custkey") % 170).cast("double"), F.lit(1.0))))
    layer = table(spark, sf, "customer").withColumn("geom", F.when(F.col("c_custkey") % 5 > 0, place))
    one = geometry_collection(layer, where="c_nationkey < 3")
    return one.select(F.size("geom.points").alias("n"), geometry_type(F.col("geom")).alias("type"), F.round(F.aggregate("geom.points", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("x"))
