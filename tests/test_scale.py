"""Work that must not grow with pairs of rows, or with copies of an expression."""

import time

import pytest
from pyspark.sql import functions as F

from geolith import schema
from geolith.functions import metrics, text
from geolith.operators import joins, spatial
from geolith.plans.fixtures import square


def test_smallest_container_among_many_that_hold_a_cell(spark):
    """20000 stacked squares hold each of 20000 points: 400 million pairs, of which few matter."""
    n = 20_000
    side = 60.0 + F.col("id") % 5
    ring = square(F.lit(0.0) - F.col("id") % 3, F.lit(0.0), side)
    exteriors = spark.range(n).select((F.lit(n) - F.col("id")).alias("ext"), F.array(ring).alias("polygon"), metrics.envelope(ring).alias("box"), (side * side).alias("area"))
    holes = spark.range(n).select(F.col("id").alias("hole"), (F.col("id") % 40 + 10.5).alias("x"), F.lit(20.5).alias("y"))
    t = time.time()
    got = joins.smallest_container(holes, exteriors, 8.0, "hole", "ext").groupBy("ext").count().collect()
    assert [tuple(r) for r in got] == [(5, n)]  # of side 60, the smallest key: id 19995
    assert time.time() - t < 90


def test_smallest_container_on_the_edge_of_a_cell(spark):
    """A smaller polygon that holds a part of a cell comes before one that holds all of it."""
    rows = [(1, 0.0, 16.0), (2, 4.0, 3.0), (3, 0.0, 8.0), (4, 0.0, 16.0)]
    b = spark.createDataFrame(rows, "ext long, at double, side double")
    ring = square(F.col("at"), F.col("at"), F.col("side"))
    exteriors = b.select("ext", F.array(ring).alias("polygon"), metrics.envelope(ring).alias("box"), (F.col("side") * F.col("side")).alias("area"))
    holes = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 9.0, 9.0), (4, 20.0, 1.0)], "hole long, x double, y double")
    got = joins.smallest_container(holes, exteriors, 8.0, "hole", "ext").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 3), (3, 1)]


def test_svg_path_makes_each_number_once(spark):
    """Two numbers to a vertex, in one place of the expression."""
    ring = square(F.col("id").cast("double"), F.lit(0.0), F.lit(1.0))
    df = spark.range(1).select(text.svg_polygon(F.array(ring), None, 1).alias("svg"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 2
    assert df.first()[0] == "M0 0 1 0 1 1 0 1Z"
    near = spark.range(1).select(text.number(F.lit(-0.04), 1), text.number(F.lit(-0.4), 0), text.number(F.lit(-10.0), 1))
    assert tuple(near.first()) == ("0", "0", "-10")


def test_smoothing_shares_vertices_within_a_set_only(spark):
    """Rings of two sets that meet by chance share nothing; copies within a set do."""
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    rows = [(1, 0, ring), (2, 0, ring), (2, 1, ring), (3, 0, [(4.0, 0.0), (9.0, 0.0), (9.0, 9.0), (4.0, 0.0)])]
    df = spark.createDataFrame(rows, schema.T.StructType([schema.T.StructField("k", schema.T.LongType()), schema.T.StructField("copy", schema.T.IntegerType()), schema.T.StructField("points", schema.RING)]))
    counts = {(r["k"], r["copy"]): set(r["counts"]) for r in spatial.with_counts(df, "k", "copy", within=("k",)).collect()}
    assert counts == {(1, 0): {1}, (2, 0): {2}, (2, 1): {2}, (3, 0): {1}}


def test_smooth_average_of_suppliers_whose_wheels_meet(spark, tmp_path):
    """Wheels 20 apart have a vertex at one place."""
    import duckdb

    from geolith.plans import registry

    path = str(tmp_path / "supplier.parquet")
    duckdb.sql("COPY (SELECT unnest(range(0, 4000)) AS s_suppkey) TO '" + path + "'")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW supplier AS FROM '{path}'")
    for name in ("smooth_average", "smooth_taubin"):
        got = registry.queries()[name](spark, str(tmp_path)).select("s_suppkey", "copy", "vertices", "area").collect()
        assert sorted(map(tuple, got)) == sorted(duckdb.sql(f"SELECT s_suppkey, copy, vertices, area FROM ({registry.oracle_sql()[name]})").fetchall())


def _area(polygons):
    from geolith.operators.regions import signed_area

    return sum(signed_area(r) for p in polygons for r in p)


@pytest.mark.parametrize(("x", "y", "side"), [(201.0, 534.0, 78.0), (553.0, 535.0, 64.0), (525.0, 511.0, 88.0)])
def test_overlay_of_squares_that_a_mesh_fails_on(x, y, side):
    from geolith.operators.triangulation import overlay

    one = [[[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]]
    window = [[[(200.0, 200.0), (600.0, 200.0), (600.0, 600.0), (200.0, 600.0), (200.0, 200.0)]]]
    shared = (min(x + side, 600) - x) * (min(y + side, 600) - y)
    want = {"intersection": shared, "difference": side * side - shared, "union": 160000 + side * side - shared}
    assert {how: _area(overlay(one, window, how)) for how in want} == pytest.approx(want)


def test_overlay_of_convex_polygons_needs_no_mesh(monkeypatch):
    """Shared edges, corners on edges, one in the other, and none of it through a triangulation; other polygons still go there."""
    from geolith.operators import triangulation as t

    sq = lambda x, y, s: [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]]
    cases = [((1.0, 1.0, 2.0), 1), ((0.0, 0.0, 2.0), 4), ((0.5, 0.5, 1.0), 1), ((-1.0, -1.0, 4.0), 4), ((1.0, 0.0, 2.0), 2), ((1.0, 0.5, 1.0), 1)]
    turned = [[[(1.0, -1.0), (3.0, 1.0), (1.0, 3.0), (-1.0, 1.0), (1.0, -1.0)]]]
    bent = [[[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 1.0), (0.0, 0.0)]]]
    assert _area(t.overlay(bent, sq(2.0, 0.0, 2.0), "intersection")) == pytest.approx(1.75)
    monkeypatch.setattr(t, "_mesh", lambda *_: pytest.fail("a mesh was made"))
    for b, shared in cases:
        got = [_area(t.overlay(sq(0.0, 0.0, 2.0), sq(*b), how)) for how in ("intersection", "difference", "union")]
        assert got == pytest.approx([shared, 4 - shared, 4 + b[2] ** 2 - shared])
    assert [_area(t.overlay(sq(0.0, 0.0, 2.0), turned, how)) for how in ("intersection", "difference", "union")] == pytest.approx([4, 0, 8])
    assert len(t.overlay(sq(0.0, 0.0, 3.0), sq(1.0, 1.0, 1.0), "difference")[0]) == 2


def test_buffer_of_a_bent_line_needs_no_mesh(monkeypatch):
    """Two stadiums are united from their edges; one bend made the mesh end with StopIteration."""
    import math
    import random

    from geolith.operators import triangulation as t

    monkeypatch.setattr(t, "_mesh", lambda *_: pytest.fail("a mesh was made"))
    rng = random.Random(3)
    for _ in range(20):
        path = [(rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for _ in range(3)]
        rings = t.buffer(path, 1e4)
        assert rings and rings[0][0] == rings[0][-1]
        for p in path:
            assert t.in_ring(rings[0], p)
    ring = t.buffer([(0.0, 0.0), (1e5, 0.0), (1e5, 1e5)], 1e4)[0]
    assert t.signed_area(ring) == pytest.approx((40 - 1) * 1e8 + 1.25 * math.pi * 1e8, rel=1e-3)


def _box_rows(spark, rows):
    return spark.createDataFrame(rows, "k long, west double, east double, south double, north double").select("k", F.struct("west", "east", "south", "north").alias("box"))


@pytest.mark.parametrize("seed", range(4))
def test_box_components_are_those_of_all_pairs(spark, seed):
    """Points, small and very large boxes, some at exactly a gap."""
    import random

    rng = random.Random(seed)
    rows = []
    for k in range(300):
        x, y = (rng.randint(0, 90) * 1.5 if seed % 2 else rng.uniform(-60, 80) for _ in "xy")
        side = rng.choice([0.0, 0.5, 1.0, 1.0, 2.0, 30.0 if k % 60 == 0 else 1.5])
        rows.append((k, x, x + side, y, y + side))
    near = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] - 1.5 <= b[2] and a[2] + 1.5 >= b[1] and a[3] - 1.5 <= b[4] and a[4] + 1.5 >= b[3]]
    root = list(range(300))
    for _ in range(300):
        before = list(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    got = joins.box_components(_box_rows(spark, rows), "k", 1.5, 4.0).collect()
    assert {r["k"]: r["component"] for r in got} == dict(enumerate(root)) and len(got) == 300


def test_box_components_without_pairs(spark):
    """60000 boxes near each other have 1.8 thousand million pairs and one component."""
    near = spark.range(60_000).select(F.col("id").alias("k"), F.struct(*[(F.col("id") % 50 * 0.1 + d).alias(n) for n, d in (("west", 0.0), ("east", 1.0), ("south", 0.0), ("north", 1.0))]).alias("box"))
    t = time.time()
    assert [tuple(r) for r in joins.box_components(near, "k", 8.0, 32.0).groupBy("component").count().collect()] == [(0, 60_000)]
    assert time.time() - t < 60
