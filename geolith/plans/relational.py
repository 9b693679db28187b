"""Queries over sets of geometries: joins, components, sequences, grids, rasters and shorelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geolith.functions import metrics, position
from geolith.operators import grid, joins, raster, sequences
from geolith.plans.fixtures import SQL, boxes, cells, points, probes, shores, square, stars, table, tiles, trajectories, with_
from geolith.plans.registry import query
from geolith.schema import point, vertex_table




@query(with_("points", "verts", "edges") + """, box AS (SELECT vec_id, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM verts GROUP BY vec_id),
pt AS (SELECT row_number() OVER () AS r, * FROM points),
cand AS (SELECT p.*, b.vec_id FROM pt p JOIN box b ON p.x BETWEEN b.w AND b.e AND p.y BETWEEN b.s AND b.n),
hit AS (SELECT c.vec_id, c.r, any_value(c.l_quantity) AS q FROM cand c JOIN edges e ON e.vec_id = c.vec_id
        WHERE (e.y1 > c.y) <> (e.y2 > c.y) AND c.x < (e.x2 - e.x1) * (c.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY c.vec_id, c.r HAVING count(*) % 2 = 1)
SELECT vec_id, CAST(count(*) AS BIGINT) AS points, round(sum(q), 2) AS quantity FROM hit GROUP BY vec_id""")
def pip_join(spark: SparkSession, sf: str) -> DataFrame:
    found = joins.points_in_polygons(points(spark, sf), stars(spark, sf).select("vec_id", "polygon", "box"), 1.0)
    return found.groupBy("vec_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


_PAIRS = "pairs AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM boxes a JOIN boxes b ON a.p_partkey < b.p_partkey AND a.x0 - 8 <= b.x0 + b.side AND a.x0 + a.side + 8 >= b.x0 AND a.y0 - 8 <= b.y0 + b.side AND a.y0 + a.side + 8 >= b.y0)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).select("p_partkey", "box")
    near = joins.boxes_within(b, b, 8.0, 32.0).where("p_partkey < other_p_partkey")
    return near.select(F.col("p_partkey").alias("a"), F.col("other_p_partkey").alias("b"))


@query("WITH " + SQL["boxes"] + ", " + _PAIRS + " SELECT a, b FROM pairs")
def bbox_band_join(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


_COMPONENTS = "both_ AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs), walk(p, c) AS (SELECT p_partkey, p_partkey FROM boxes UNION SELECT both_.v, walk.c FROM walk JOIN both_ ON walk.p = both_.u WHERE walk.c < both_.v), comp AS (SELECT p AS p_partkey, min(c) AS component FROM walk GROUP BY p)"


@query("WITH RECURSIVE " + SQL["boxes"] + ", " + _PAIRS + ", " + _COMPONENTS + " SELECT p_partkey, component FROM comp")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return joins.box_components(boxes(spark, sf), "p_partkey", 8.0, 32.0)


@query("WITH RECURSIVE " + SQL["boxes"] + ", " + _PAIRS + ", " + _COMPONENTS + " SELECT component, CAST(count(*) AS BIGINT) AS members, round(sum(side * side), 4) AS area FROM comp JOIN boxes USING (p_partkey) GROUP BY component HAVING sum(side * side) >= 40")
def cluster_having_area(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).select("p_partkey", (F.col("side") * F.col("side")).alias("area"))
    named = connected_components(spark, sf).join(b, "p_partkey")
    return named.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("area"), 4).alias("area"), F.sum("area").alias("whole")).where("whole >= 40").drop("whole")


@query("WITH " + SQL["boxes"] + """, inner_ AS (SELECT p_partkey AS hole, x0 + side / 2 AS x, y0 + side / 2 AS y FROM boxes),
outer_ AS (SELECT p_partkey AS ext, x0 - 20 AS w, x0 + side + 20 AS e, y0 - 20 AS s, y0 + side + 20 AS n, (side + 40) * (side + 40) AS area FROM boxes)
SELECT hole, arg_min(ext, {'a': area, 'k': ext}) AS ext FROM inner_ JOIN outer_ ON x >= w AND x < e AND y >= s AND y < n GROUP BY hole""")
def hole_assignment_smallest(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    holes = b.select(F.col("p_partkey").alias("hole"), (F.col("x0") + F.col("side") / 2).alias("x"), (F.col("y0") + F.col("side") / 2).alias("y"))
    side = F.col("side") + 40.0
    ring = square(F.col("x0") - 20.0, F.col("y0") - 20.0, side)
    exteriors = b.select(F.col("p_partkey").alias("ext"), F.array(ring).alias("polygon"), metrics.envelope(ring).alias("box"), (side * side).alias("area"))
    return joins.smallest_container(holes, exteriors, 8.0, "hole", "ext")


def _corner_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Nation tiles as polygons whose corners touch."""
    x0, y0 = F.col("x0"), F.col("y0")
    ring = F.array(point(x0, y0), point(x0 + 72.0, y0), point(x0 + 72.0, y0 + 34.0), point(x0, y0 + 34.0), point(x0, y0))
    return tiles(spark, sf).select("n_nationkey", F.array(ring).alias("polygon"))


@query(with_("tiles") + ", c AS (SELECT x0 + 72 * dx AS x, y0 + 34 * dy AS y FROM tiles, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) v(dx, dy)) SELECT x, y, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY x, y")
def vertex_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.vertex_counts(vertex_table(_corner_grid(spark, sf), "n_nationkey", "polygon"), "n_nationkey")


@query(with_("tiles") + ", c AS (SELECT DISTINCT x0 + 72 * dx AS x, y0 + 34 * dy AS y FROM tiles, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) v(dx, dy)) SELECT x, y, CAST(dense_rank() OVER (ORDER BY x, y) AS BIGINT) AS vertex FROM c")
def vertex_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.vertex_ids(vertex_table(_corner_grid(spark, sf), "n_nationkey", "polygon"))


@query(with_("tiles") + """, e AS (SELECT x0 + 72 * ax AS x1, y0 + 34 * ay AS y1, x0 + 72 * bx AS x2, y0 + 34 * by_ AS y2 FROM tiles, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) v(ax, ay, bx, by_))
SELECT x1, y1, x2, y2 FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.x1 = e.x2 AND o.y1 = e.y2 AND o.x2 = e.x1 AND o.y2 = e.y1)""")
def boundary_half_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose reverse no other polygon has."""
    return sequences.boundary_edges(vertex_table(_corner_grid(spark, sf), "n_nationkey", "polygon"), "n_nationkey")


# -- sequences ----------------------------------------------------------------

@query("WITH " + SQL["traj"] + " SELECT user_id, idx, round(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 6) AS step FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)")
def adjacent_distance(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.with_step(trajectories(spark, sf), "user_id").select("user_id", F.col("idx").cast("long").alias("idx"), F.round("step", 6).alias("step"))


@query("WITH " + SQL["traj"] + """, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) > 120, false) AS jump FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
r AS (SELECT *, sum(CAST(jump AS INT)) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, min(idx) AS first, max(idx) AS last FROM r GROUP BY user_id, run""")
def jump_split_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = sequences.split_runs(trajectories(spark, sf), "user_id", 120.0)
    return runs.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").cast("long").alias("first"), F.max("idx").cast("long").alias("last"))


@query("WITH " + SQL["traj"] + """, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) > 120, false) AS jump FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
r AS (SELECT *, sum(CAST(jump AS INT)) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM s),
m AS (SELECT user_id, max(run) AS last, sqrt(pow(arg_min(x, idx) - arg_max(x, idx), 2) + pow(arg_min(y, idx) - arg_max(y, idx), 2)) <= 120 AS meets FROM r GROUP BY user_id)
SELECT r.user_id, CAST(CASE WHEN meets AND run = last THEN 0 ELSE run END AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n FROM r JOIN m ON r.user_id = m.user_id GROUP BY ALL""")
def jump_split_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of rings: the last one goes on in the first."""
    runs = sequences.split_runs(trajectories(spark, sf), "user_id", 120.0, cyclic=True)
    return runs.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + SQL["verts"] + ", " + SQL["edges"] + """, d AS (SELECT *, sqrt(pow((x2 - x1) * 111320 * cos(radians((y1 + y2) / 2)), 2) + pow((y2 - y1) * 111320, 2)) AS m FROM edges),
s AS (SELECT *, greatest(1, CAST(ceil(round(m / 50000, 9)) AS BIGINT)) AS n FROM d), k AS (SELECT *, unnest(range(0, n)) AS k FROM s)
SELECT vec_id, CAST(count(*) AS BIGINT) AS n, round(sum(x1 + k / CAST(n AS DOUBLE) * (x2 - x1)), 4) AS sx, round(sum(y1 + k / CAST(n AS DOUBLE) * (y2 - y1)), 4) AS sy FROM k GROUP BY vec_id""")
def densify_geographic(spark: SparkSession, sf: str) -> DataFrame:
    v = vertex_table(stars(spark, sf), "vec_id", "polygon")
    dense = sequences.densified(v, 50.0, "vec_id").where("not last")
    return dense.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"))


@query("WITH " + SQL["verts"] + ", " + SQL["edges"] + """, d AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS m FROM edges), s AS (SELECT *, greatest(1, CAST(ceil(round(m / CAST(0.4 AS DOUBLE), 9)) AS BIGINT)) AS n FROM d)
SELECT vec_id, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY vec_id""")
def densify_planar(spark: SparkSession, sf: str) -> DataFrame:
    v = vertex_table(stars(spark, sf), "vec_id", "polygon")
    return sequences.densified(v, 0.4, "vec_id", planar=True).where("not last").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + SQL["traj"] + ", t AS (SELECT user_id, idx, round(x / 50) * 50 AS x, round(y / 50) * 50 AS y FROM traj), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM t WINDOW w AS (PARTITION BY user_id ORDER BY idx)) SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM l WHERE px IS NULL OR px <> x OR py <> y GROUP BY user_id")
def duplicate_vertices(spark: SparkSession, sf: str) -> DataFrame:
    coarse = trajectories(spark, sf).withColumns({n: F.round(F.col(n) / 50) * 50 for n in "xy"})
    return sequences.without_repeats(coarse, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + SQL["traj"] + ", t AS (SELECT user_id, idx, trunc(x / 50) AS x, trunc(y / 50) AS y FROM traj), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM t WINDOW w AS (PARTITION BY user_id ORDER BY idx)) SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM l WHERE px IS NULL OR px <> x OR py <> y GROUP BY user_id")
def duplicate_vertices_grid(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.without_repeats(trajectories(spark, sf), "user_id", grid=50.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_W = "WITH " + SQL["traj"] + """, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, idx, round(CASE WHEN step >= 100 THEN 0 ELSE 1 END, 6) AS average, round(CASE WHEN step >= 100 THEN 0 ELSE (100 - step) / 100 END, 6) AS linear, round(CASE WHEN step >= 100 THEN 0 ELSE exp(-(step * step) / (2 * 150 * 150)) END, 6) AS gaussian, round(CASE WHEN step >= 100 THEN 0 ELSE pow(1 - pow(step / 100, 2), 2) END, 6) AS tukey FROM s"""


@query(_W)
def kernel_weights(spark: SparkSession, sf: str) -> DataFrame:
    step = F.coalesce("step", F.lit(0.0))
    rows = sequences.with_step(trajectories(spark, sf), "user_id")
    return rows.select("user_id", F.col("idx").cast("long").alias("idx"), *[F.round(sequences.kernel(k, step, 100.0), 6).alias(k) for k in ("average", "linear", "gaussian", "tukey")])


@query("WITH " + SQL["traj"] + ", n AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)) SELECT user_id, idx, round(abs((x - ax) * (by_ - ay) - (bx - ax) * (y - ay)) / 2, 6) AS area FROM n WHERE ax IS NOT NULL AND bx IS NOT NULL")
def triangle_effective_area(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.effective_area(trajectories(spark, sf), "user_id").select("user_id", F.col("idx").cast("long").alias("idx"), F.round("area", 6).alias("area"))


@query("WITH " + SQL["traj"] + ", s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)), c AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY idx) AS along FROM s) SELECT a.user_id, a.idx, round(sum(b.x * (150 - abs(b.along - a.along)) / 150) / sum((150 - abs(b.along - a.along)) / 150), 4) AS x, round(sum(b.y * (150 - abs(b.along - a.along)) / 150) / sum((150 - abs(b.along - a.along)) / 150), 4) AS y FROM c a JOIN c b ON a.user_id = b.user_id AND abs(b.along - a.along) < 150 GROUP BY a.user_id, a.idx")
def smooth_window(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of a linear kernel over path length, as a window of its range."""
    out = sequences.smoothed_window(trajectories(spark, sf), "user_id", 150.0)
    return out.select("user_id", F.col("idx").cast("long").alias("idx"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# -- grids --------------------------------------------------------------------

_GRID = "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, -180 + i * (CAST(360 AS DOUBLE) / 36) AS x, -85 + j * (CAST(170 AS DOUBLE) / 34) AS y FROM (SELECT unnest(range(0, 37)) AS i), (SELECT unnest(range(0, 35)) AS j)"


def _grid(spark: SparkSession) -> DataFrame:
    return grid.generate(spark, 37, 35, -180.0, -85.0, 180.0, 85.0)


@query(f"SELECT i, j, round(x, 6) AS x, round(y, 6) AS y FROM ({_GRID})")
def grid_generate(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark).select("i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_("points") + "SELECT l_orderkey, l_linenumber, x, y, round(2 * x + y, 6) AS px, round(x - 3 * y, 6) AS py FROM points")
def grid_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolation of a linear map, which it must give exactly."""
    x, y = F.col("x"), F.col("y")
    known = _grid(spark).select("i", "j", (2 * x + y).alias("px"), (x - 3 * y).alias("py"))
    out = grid.bilinear(points(spark, sf).drop("l_quantity"), known, 37, 35, -180.0, -85.0, 180.0, 85.0)
    return out.withColumns({n: F.round(F.col(n), 6) for n in ("px", "py")})


@query(f"SELECT i, j, round(CAST(6378137 AS DOUBLE) * radians(x) / 1000, 3) + 0 AS x, round(CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + radians(y) / 2)) / 1000, 3) + 0 AS y FROM ({_GRID})")
def grid_projected(spark: SparkSession, sf: str) -> DataFrame:
    out = grid.projected(_grid(spark), "+proj=webmerc")
    return out.select("i", "j", *[(F.round(F.col(n) / 1000, 3) + F.lit(0.0)).alias(n) for n in "xy"])


@query(f"WITH g AS ({_GRID}) SELECT i, j, CASE WHEN i % 7 = 3 THEN 'oblong' WHEN j >= 20 THEN 'clockwise' ELSE 'counterclockwise' END AS quality FROM g WHERE i < 36 AND j < 34")
def grid_cell_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a bent grid: squeezed columns, and rows that run the other way from the twentieth on."""
    i, j = F.col("i"), F.col("j")
    squeezed = i * 100.0 - F.floor((i + 3) / 7) * 99.9
    bent = _grid(spark).select("i", "j", squeezed.alias("x"), F.when(j <= 20, -j * 100.0).otherwise(-2000.0 + (j - 20) * 100.0).alias("y"))
    turned = grid.cell_quality(bent)
    return turned


@query("SELECT CAST(21 AS BIGINT) AS shift")
def grid_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Where a global row wraps: longitudes that run past the antimeridian between columns 20 and 21."""
    turned = _grid(spark).select("i", "j", F.when(F.col("i") > 20, F.col("i") * 0.05 - 360.0).otherwise(F.col("i") * 0.05).alias("x"), F.lit(0.0).alias("y"))
    return grid.wrap_shift(turned, 35).select(F.col("shift").cast("long").alias("shift"))


_MASKS = f"g AS ({_GRID}), m AS (SELECT i, j, (i * 7 + j * 3) % 5 < 2 AS a, (i + j) % 3 = 0 AS b FROM g)"


def _masks(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    g = _grid(spark)
    return g.select("i", "j", ((F.col("i") * 7 + F.col("j") * 3) % 5 < 2).alias("flag")), g.select("i", "j", ((F.col("i") + F.col("j")) % 3 == 0).alias("flag"))


@query(f"WITH {_MASKS} SELECT i, j, a AND b AS both_set, a OR b AS any_set, a <> b AS one_set, NOT a AS not_set FROM m")
def boolmatrix_ops(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _masks(spark)
    out = a.select("i", "j", (~F.col("flag")).alias("not_set"))
    for how, name in (("and", "both_set"), ("or", "any_set"), ("xor", "one_set")):
        out = out.join(grid.combine(a, b, how).withColumnRenamed("flag", name), ["i", "j"])
    return out


@query(f"WITH {_MASKS} SELECT min(i) AS imin, min(j) AS jmin, max(i) AS imax, max(j) AS jmax FROM m WHERE a AND i BETWEEN 5 AND 30 AND j > 7")
def boolmatrix_bbox(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = _masks(spark)
    return grid.mask_box(a.withColumn("flag", F.col("flag") & F.col("i").between(5, 30) & (F.col("j") > 7)), 37, 35)


@query(f"WITH {_MASKS} SELECT CAST(sum(CASE WHEN j >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS cw, CAST(sum(CASE WHEN j >= 20 THEN 0 ELSE 1 END) AS BIGINT) AS ccw, false AS needs_flipping FROM g WHERE i < 36 AND j < 34 AND i % 7 <> 3")
def grid_handedness(spark: SparkSession, sf: str) -> DataFrame:
    return grid.needs_flipping(grid_cell_quality(spark, sf))


# -- rasters ------------------------------------------------------------------

def _level(k: str, size: int, missing: str) -> str:
    w = f"(CAST(1 AS DOUBLE) / {size})"
    return f"""{k} AS (SELECT p.o_orderkey, t.tile_lon IS NOT NULL AS tile, CASE WHEN c.value IN ({missing}) THEN NULL ELSE c.value END AS value FROM probes p
LEFT JOIN (SELECT DISTINCT tile_lon, tile_lat FROM cells WHERE level_size = {size}) t ON t.tile_lon = floor(p.lon + 180) - 180 AND t.tile_lat = floor(p.lat + 90) - 90
LEFT JOIN cells c ON c.level_size = {size} AND c.tile_lon = t.tile_lon AND c.tile_lat = t.tile_lat AND c.cell_i = CAST(floor((p.lon + 180 - floor(p.lon + 180)) / {w}) AS INT) AND c.cell_j = CAST(floor((p.lat + 90 - floor(p.lat + 90)) / {w}) AS INT))"""


_RASTER = with_("cells", "probes") + ", " + _level("fine", 40, "-32768") + ", " + _level("wide", 10, "-32768")


@query(with_("cells", "probes") + ", " + _level("fine", 40, "-32768") + " SELECT o_orderkey, CAST(coalesce(value, CASE WHEN NOT tile THEN 0 END) AS INT) AS elevation FROM fine")
def dem_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return raster.elevation(probes(spark, sf), cells(spark, sf), [40]).select("o_orderkey", "elevation")


@query(_RASTER + " SELECT f.o_orderkey, CAST(coalesce(f.value, w.value, CASE WHEN NOT w.tile THEN 0 END) AS INT) AS elevation FROM fine f JOIN wide w ON f.o_orderkey = w.o_orderkey")
def dem_level_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return raster.elevation(probes(spark, sf), cells(spark, sf), [10, 40]).select("o_orderkey", "elevation")


@query(with_("cells", "probes") + ", " + _level("wide", 10, "-32768") + " SELECT o_orderkey, CAST(coalesce(value, CASE WHEN NOT tile THEN 0 END) AS INT) AS elevation FROM wide")
def dem_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A resolution of 11 km needs 9 cells a side, so the coarse level is probed alone."""
    return raster.elevation(probes(spark, sf), cells(spark, sf), [10, 40], resolution_km=11.0).select("o_orderkey", "elevation")


_COVER = "CASE value % 5 WHEN 0 THEN 210 WHEN 1 THEN 240 WHEN 2 THEN 230 WHEN 3 THEN 100 ELSE 190 END"


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).withColumn("value", F.when(F.col("value") == raster.MISSING, raster.MISSING).otherwise(F.expr(_COVER)))


_CLASSES = with_("cells", "probes").replace("cells AS (", "raw AS (", 1).replace("probes AS (", f"cells AS (SELECT * REPLACE (CASE WHEN value = -32768 THEN value ELSE {_COVER} END AS value) FROM raw), probes AS (", 1) + ", " + _level("fine", 40, "-32768, 230") + ", " + _level("wide", 10, "-32768, 230") + ", cov AS (SELECT f.o_orderkey, CAST(coalesce(f.value, w.value, 240) AS INT) AS cover FROM fine f JOIN wide w ON f.o_orderkey = w.o_orderkey)"


@query(_CLASSES + " SELECT o_orderkey, cover FROM cov")
def landcover_class(spark: SparkSession, sf: str) -> DataFrame:
    return raster.cover(probes(spark, sf), _classes(spark, sf), [10, 40]).select("o_orderkey", "cover")


@query(_CLASSES + " SELECT cover, CAST(count(*) AS BIGINT) AS n, cover IN (210, 240, 241) AS water FROM cov GROUP BY cover")
def open_water_share(spark: SparkSession, sf: str) -> DataFrame:
    found = raster.cover(probes(spark, sf), _classes(spark, sf), [10, 40]).groupBy("cover").agg(F.count(F.lit(1)).alias("n"))
    return found.select("cover", "n", raster.is_open_water(F.col("cover")).alias("water"))


# -- shorelines ---------------------------------------------------------------

@query(with_("shores") + "SELECT o_orderkey, level, area_km2 FROM shores WHERE level <= 2 AND area_km2 >= CASE WHEN level = 2 THEN 8000 ELSE 5000 END")
def shoreline_header_filter(spark: SparkSession, sf: str) -> DataFrame:
    from geolith.sources.gshhs import header_filter

    return shores(spark, sf).where(header_filter(F.col("level"), F.col("area_km2"), most_level=2, least_island=5000.0, least_lake=8000.0)).select("o_orderkey", "level", "area_km2")


@query(with_("shores") + "SELECT o_orderkey FROM shores WHERE south <= 40 AND north >= -40 AND ((west <= 200 AND east >= 160) OR (west + 360 <= 200 AND east + 360 >= 160) OR (west - 360 <= 200 AND east - 360 >= 160))")
def shoreline_bbox_antimeridian(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    window = [F.lit(v) for v in (160.0, -160.0, -40.0, 40.0)]
    return shores(spark, sf).where(position.envelopes_overlap(c("west"), c("east"), c("south"), c("north"), *window)).select("o_orderkey")


@query("WITH " + SQL["verts"] + ", " + SQL["edges"] + ", m AS (SELECT vec_id, sum(sqrt(pow((x2 - x1) * 111.32 * cos(radians((y1 + y2) / 2)), 2) + pow((y2 - y1) * 111.32, 2))) AS l, abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * (CAST(6378137 AS DOUBLE) * 6378137 / 2) / 1000000 AS a FROM edges GROUP BY vec_id) SELECT vec_id, round(4 * pi() * a / (l * l), 5) AS roundness FROM m WHERE vec_id % 4 = 0 OR round(4 * pi() * a / (l * l), 5) >= CAST(0.06 AS DOUBLE)")
def shoreline_roundness(spark: SparkSession, sf: str) -> DataFrame:
    from geolith.sources.gshhs import flat_length_km, keeps_shape

    level = (F.col("vec_id") % 4 + 1).cast("int")
    rows = stars(spark, sf).select("vec_id", level.alias("level"), (metrics.area_sphere(F.col("ring")) / 1e6).alias("area"), flat_length_km(F.col("ring")).alias("length"))
    value = F.round(metrics._ratio(F.col("area"), F.col("length")), 5)
    return rows.select("vec_id", "level", value.alias("roundness")).where(keeps_shape(F.col("level"), F.col("roundness"), 0.06)).select("vec_id", "roundness")
