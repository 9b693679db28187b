import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith import schema
from geolith.functions import metrics
from geolith.operators import grid, joins, project, raster, sequences, spatial
from geolith.operators.regions import Geometry, signed_area
from geolith.sources import features, gshhs, hgt
from geolith.streaming import stateless


def boxes(spark, rows):
    return spark.createDataFrame(rows, "k long, west double, east double, south double, north double").select("k", F.struct("west", "east", "south", "north").alias("box"))


@pytest.mark.parametrize("parts", [1, 8])
def test_band_join_and_components(spark, parts):
    rng = random.Random(2)
    rows = [(k, x, x + 1, y, y + 1) for k in range(150) for x, y in [(rng.uniform(0, 60), rng.uniform(0, 60))]]
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] - 1.5 <= b[2] and a[2] + 1.5 >= b[1] and a[3] - 1.5 <= b[4] and a[4] + 1.5 >= b[3]}
    df = boxes(spark, rows).repartition(parts)
    got = joins.boxes_within(df, df, 1.5, 4.0).where("k < other_k").select("k", "other_k")
    assert got.count() == len(near) and {tuple(r) for r in got.collect()} == near
    root = list(range(150))
    for _ in range(150):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    comp = joins.connected_components(df, got, "k", "k", "other_k").collect()
    assert {r["k"]: r["component"] for r in comp} == dict(enumerate(root))


def test_points_in_polygons_match_brute_force(spark):
    rng = random.Random(4)
    stars = []
    for k in range(20):
        cx, cy = rng.uniform(0, 50), rng.uniform(0, 50)
        pts = [(cx + r * math.cos(a), cy + r * math.sin(a)) for i in range(9) for a, r in [(2 * math.pi * i / 9, rng.uniform(1, 8))]]
        stars.append((k, [[*pts, pts[0]]]))
    points = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(300)]
    from geolith.operators.regions import in_ring

    want = {(i, k) for i, x, y in points for k, p in stars if in_ring(p[0], (x, y))}
    p = spark.createDataFrame(points, "i int, x double, y double")
    s = spark.createDataFrame(stars, "k int, polygon array<array<struct<x double, y double>>>").withColumn("box", metrics.envelope(F.get("polygon", F.lit(0))))
    got = {(r["i"], r["k"]) for r in joins.points_in_polygons(p, s, 6.0).collect()}
    assert got == want


def test_raster(spark):
    cells = spark.createDataFrame([(2, 0, 0, 0, 0, 5), (2, 0, 0, 1, 0, -32768), (2, 0, 0, 0, 1, 7), (2, 0, 0, 1, 1, -32768), (1, 0, 0, 0, 0, 9)], "level_size int, tile_lon int, tile_lat int, cell_i int, cell_j int, value int")
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.9, 0.1), (3, 0.1, 0.9), (4, 5.0, 5.0), (5, 300.0, 0.0)], "k int, lon double, lat double")
    both = {r["k"]: r["elevation"] for r in raster.elevation(points, cells, [1, 2]).collect()}
    assert both == {1: 5, 2: 9, 3: 7, 4: 0, 5: None}
    fine = {r["k"]: r["elevation"] for r in raster.elevation(points, cells, [2]).collect()}
    assert fine == {1: 5, 2: None, 3: 7, 4: 0, 5: None}
    assert raster.levels_for([401, 1201, 3601], 0.1) == [1201, 401] and raster.levels_for([10], 1e-9) == [10]
    with pytest.raises(ValueError):
        raster.levels_for([10], -1)
    cover = {r["k"]: r["cover"] for r in raster.cover(points, cells.withColumn("value", F.when(F.col("value") == 5, 230).otherwise(F.col("value"))), [1, 2]).collect()}
    assert cover[1] == 9 and cover[4] == raster.SEA


def test_grids(spark):
    g = grid.generate(spark, 3, 3, 0, 0, 2, 2)
    assert g.count() == 9 and g.agg(F.max("x")).first()[0] == 2
    out = grid.bilinear(spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (3.0, 0.0)], "x double, y double"), g.select("i", "j", (F.col("x") * 10).alias("px"), F.col("y").alias("py")), 3, 3, 0, 0, 2, 2)
    assert {(r["x"], r["px"]) for r in out.collect()} == {(0.5, 5.0), (2.0, 20.0), (3.0, None)}
    assert {r["quality"] for r in grid.cell_quality(g).collect()} == {"clockwise"}
    empty = grid.mask_box(g.select("i", "j", F.lit(False).alias("flag")), 3, 3).first()
    assert tuple(empty) == (3, 3, 0, 0)


def test_sequences(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, None, None), (1, 3, 50.0, 0.0), (1, 4, 51.0, 0.0), (1, 5, 90.0, 0.0)], "k int, idx int, x double, y double")
    runs = sequences.split_runs(v, "k", 10.0).groupBy("run").count().orderBy("run").collect()
    assert [r["count"] for r in runs] == [2, 2, 1]
    pole = spark.createDataFrame([(1, 0, 0.0, 90.0), (1, 1, 36.0, 90.0)], "k int, idx int, x double, y double")
    assert sequences.densified(pole, 1000.0, "k").count() == 6


def test_simplify_keeps_shared_borders(spark):
    left = [(0.0, 0.0), (2.0, 0.0), (2.1, 1.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    right = [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.1, 1.0), (2.0, 0.0)]
    df = spark.createDataFrame([(1, left), (2, right)], "k int, points array<struct<x double, y double>>")
    got = {r["k"]: {tuple(p) for p in r["points"]} for r in spatial.simplify(df, 1.0, "k").collect()}
    assert (2.1, 1.0) not in got[1] and (2.1, 1.0) not in got[2] and (2.0, 0.0) in got[1] & got[2]


def test_amalgamate(spark):
    def sq(x, y, s):
        return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]

    rows = [(i * 10 + j, sq(float(i), float(j), 0.8)) for i in range(10) for j in range(10)] + [(100, sq(10.3, 0.0, 5.0)), (101, sq(40.0, 40.0, 1.0))]
    df = spark.createDataFrame(rows, "k long, polygon array<array<struct<x double, y double>>>")
    got = spatial.amalgamate(df, "k", 0.3, 2.0, mainland=20.0).collect()
    assert sorted(round(r["area"], 4) for r in got) == [25.0, 96.04]
    assert spatial.amalgamate(df, "k", 0.0, 2.0).count() == 1
    assert spatial.amalgamate(df, "k", 0.3, 0.0, least_total=70.0).count() == 0
    bay = [(0, 0), (3, 0), (3, 3), (1.6, 3), (1.6, 1), (1.4, 1), (1.4, 3), (0, 3), (0, 0)]
    one = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in bay]])], "k long, polygon array<array<struct<x double, y double>>>")
    assert spatial.amalgamate(one, "k", 0.3, mainland=1.0).first()["area"] == pytest.approx(8.6)
    assert spatial.amalgamate(one, "k", 0.3, mainland=1.0, close_bays=True).first()["area"] == pytest.approx(9, abs=0.01)


def test_boxes_of_any_size_meet(spark):
    """Boxes from a thousandth of a cell to a thousand cells, against all pairs."""
    import random

    rng = random.Random(3)
    rows = [(k, rng.uniform(0, 900), rng.uniform(0, 900), 10 ** rng.uniform(-2, 3), 10 ** rng.uniform(-2, 3)) for k in range(150)]
    df = spark.createDataFrame(rows, "k long, x double, y double, w double, h double").selectExpr("k", "struct(x AS west, x + w AS east, y AS south, y + h AS north) AS box")
    got = joins.boxes_within(df, df, 1.5, 4.0).where("k < other_k").select("k", "other_k").collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] - 1.5 <= b[1] + b[3] and a[1] + a[3] + 1.5 >= b[1] and a[2] - 1.5 <= b[2] + b[4] and a[2] + a[4] + 1.5 >= b[2]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_amalgamate_query_joins_across_a_gap_of_8(spark):
    """The gap that FIXTURES.md names for these boxes: the query's polygons are those of gap 8, and fewer than those of gap 1."""
    from geolith.plans import registry
    from geolith.plans.fixtures import boxes, square

    sf = "/root/testdata/sf0.01"
    polygons = boxes(spark, sf).where("side > 0").select("p_partkey", F.array(square(F.col("x0"), F.col("y0"), F.col("side"))).alias("polygon"))
    areas = lambda gap: sorted(round(r["area"], 4) for r in spatial.amalgamate(polygons, "p_partkey", gap, 4.0, mainland=24.0).collect())
    got = sorted(r["area"] for r in registry.queries()["amalgamate"](spark, sf).collect())
    assert got == pytest.approx(areas(8.0)) and got != areas(1.0)


def test_interrupts_and_projection():
    assert project.interrupt("+proj=merc").cuts == [(180 - 1e-6, -90.0, 180 + 1e-6, 90.0), (-180 - 1e-6, -90.0, -180 + 1e-6, 90.0)]
    assert project.interrupt("+proj=laea +lat_0=52 +lon_0=10").away[0][:2] == (-170.0, -52.0)
    assert project.interrupt("+proj=ortho").keep and project.interrupt("+proj=imw_p") == project.Interrupt()
    line = Geometry([], [[(170.0, 10.0), (190.0, 10.0)]], [])
    cut = project.interrupted(line, project.interrupt("+proj=eqc"))
    assert len(cut.lines) == 2
    far = Geometry([], [], [(180.0, 0.0)])
    assert project.interrupted(far, project.interrupt("+proj=gnom")) is None

    def merc(places):
        p = np.asarray(places, float).reshape(-1, 2)
        y = np.log(np.tan(np.pi / 4 + np.radians(np.clip(p[:, 1], -89.99, 89.99)) / 2)) * 6378137
        return np.where(np.abs(p[:, 1:]) < 89.99, np.stack([np.radians(p[:, 0]) * 6378137, y], axis=1), np.nan)

    world = Geometry([[[(-179.0, -80.0), (179.0, -80.0), (179.0, 80.0), (-179.0, 80.0), (-179.0, -80.0)]]], [], [])
    bounds = (-1e7, -1e7, 1e7, 1e7)
    got = project.project(world, merc, bounds)
    assert sum(signed_area(r) for p in got.polys for r in p) == pytest.approx(4e14, rel=1e-6)
    assert all(-1e7 <= c <= 1e7 for p in got.polys for r in p for q in r for c in q)
    assert project.project(Geometry([], [], [(0.0, 89.999)]), merc, bounds) is None
    broken = project.project(Geometry([], [[(0.0, 0.0), (0.0, 89.999), (10.0, 0.0)]], []), merc, bounds)
    assert len(broken.lines) == 2


def shoreline(order, rows):
    out = b""
    for ident, level, ring, area in rows:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        out += struct.pack(f"{order}8i2h", ident, len(ring), level, int(min(xs) * 1e6), int(max(xs) * 1e6), int(min(ys) * 1e6), int(max(ys) * 1e6), int(area * 10), 0, 1)
        out += b"".join(struct.pack(f"{order}2i", int(x * 1e6), int(y * 1e6)) for x, y in ring)
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_shorelines(spark, tmp_path, order):
    ring = [(200.0, 0.0), (201.0, 0.0), (201.0, 1.0), (200.0, 1.0), (200.0, 0.0)]
    thin = [(10.0, 0.0), (20.0, 0.0), (20.0, 0.01), (10.0, 0.01), (10.0, 0.0)]
    (tmp_path / "shore.b").write_bytes(shoreline(order, [(1, 1, ring, 12000.0), (2, 2, thin, 1200.0), (3, 3, ring, 5.0)]))
    got = gshhs.read(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in got] == [1, 2, 3] and got[0]["ring"][0]["x"] == -160.0 and got[0]["area_km2"] == 12000.0
    assert [r["id"] for r in gshhs.read(spark, str(tmp_path), most_level=2, least_roundness=0.2).collect()] == [1]
    assert [r["id"] for r in gshhs.read(spark, str(tmp_path), least_island=10.0, least_lake=2000.0).collect()] == [1]
    assert [r["id"] for r in gshhs.read(spark, str(tmp_path), window=(5.0, 15.0, -1.0, 1.0)).collect()] == [2]


def test_points_of_unwanted_shorelines_are_stepped_over(monkeypatch):
    """Headers alone decide: the points of records that fail them are never decoded."""
    good = shoreline("<", [(k, 1 + k % 4, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], 10.0 * k) for k in range(12)])
    read, decode = [], np.frombuffer

    def counted(data, dtype, *a, **k):
        read.append(dtype)
        return decode(data, dtype, *a, **k)

    monkeypatch.setattr(gshhs.np, "frombuffer", counted)
    got = [r[0] for r in gshhs.parse(good, gshhs.Wanted(most_level=1, least_island=50.0))]
    assert got == [8] and len(read) == 1


def test_broken_shorelines():
    good = shoreline("<", [(1, 1, [(0.0, 0.0), (1.0, 1.0)], 1.0)])
    with pytest.raises(ValueError):
        list(gshhs.parse(good[:-3]))
    with pytest.raises(ValueError):
        list(gshhs.parse(good[:20]))
    with pytest.raises(ValueError):
        list(gshhs.parse(b"\0" * 60))
    assert list(gshhs.parse(b"")) == []


def test_tiles(spark, tmp_path):
    n = 3
    values = np.arange(n * n, dtype=">i2").reshape(n, n)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "N60E025.hgt").write_bytes(values.tobytes())
    (tmp_path / "S01W002.hgt").write_bytes(values.tobytes())
    (tmp_path / "N61E025.hgt").write_bytes(b"123")
    (tmp_path / "other.hgt").write_bytes(values.tobytes())
    cells = hgt.read(spark, str(tmp_path))
    assert {(r[0], r[1]) for r in cells.select("tile_lon", "tile_lat").distinct().collect()} == {(25, 60), (-2, -1)}
    point = spark.createDataFrame([(25.01, 60.01), (25.99, 60.99)], "lon double, lat double")
    assert sorted(r["elevation"] for r in raster.elevation(point, cells, [3]).collect()) == [2, 6]


def test_features(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "b", b"y")], "id long, name string, raw binary")
    got = features.read_features(df, ["id", "name", "raw", "none"], "id < 2", compatible=True)
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [(1, "")]
    assert "5432" in features.Host("h", "d", "u", "p").options()["url"]
    g = spark.range(2).select(F.when(F.col("id") == 0, schema.geometry(points=F.array(schema.point(F.lit(1.0), F.lit(2.0))))).alias("geom"))
    assert len(features.geometry_collection(g).first()["geom"]["points"]) == 1


def test_streams(spark, tmp_path):
    from geolith.functions.position import Box

    rows = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") / 10).alias("y"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    polygon = F.array(F.array(*[schema.point(F.lit(a), F.lit(b)) for a, b in ((0.5, 0.5), (4.5, 0.5), (4.5, 4.5), (0.5, 4.5), (0.5, 0.5))]))
    shapes = spark.range(1).select(F.col("id").alias("k"), polygon.alias("polygon"), metrics.envelope(polygon[0]).alias("box"))
    out = stateless.within(stateless.positions(stream, Box(0, 0, 9, 9)), shapes, 2.0)
    q = out.writeStream.format("memory").queryName("held").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("held").count() == stateless.within(rows, shapes, 2.0).count() == 16
    counted = stateless.counts_by_time(stream, "ts", "100 seconds", "0 seconds")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("counted").collect()] == [10] * 10
