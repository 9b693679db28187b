import math

import pytest
from pyspark.sql import functions as F

from geolith import schema
from geolith.functions import codec, metrics, position, projections, text
from geolith.functions.sql import register
from geolith.operators import spatial
from geolith.operators.regions import Box, Circle


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring(*points):
    return F.array(*[schema.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
HOLE = [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25), (0.25, 0.25)]


def test_metrics(spark):
    holed = F.array(ring(*SQUARE), ring(*HOLE))
    r = one(spark, metrics.signed_area(ring(*SQUARE[::-1])), metrics.polygon_area(holed), metrics.compactness(holed), metrics.compactness(holed, net=True), metrics.in_polygon(holed, F.lit(0.1), F.lit(0.1)), metrics.in_polygon(holed, F.lit(0.5), F.lit(0.5)), metrics.signed_area(ring((0, 0))))
    assert r[0] == -1 and r[1] == 0.75 and r[2] == pytest.approx(math.pi / 4) and r[3] == pytest.approx(4 * math.pi * 0.75 / 36)
    assert r[4] is True and r[5] is False and r[6] == 0
    turned = one(spark, metrics.from_smallest(ring(*[(1, 1), (0, 1), (0, 0), (1, 0), (1, 1)])), metrics.wound(ring(*SQUARE[::-1])), metrics.closed(ring((0, 0), (1, 0), (1, 1), (1e-9, 0))))
    assert tuple(turned[0][0]) == (0, 0) and tuple(turned[0][-1]) == (0, 0) and len(turned[0]) == 5
    assert [tuple(p) for p in turned[1]] == SQUARE and tuple(turned[2][-1]) == (0, 0)


def test_positions(spark):
    box = position.Box(0, 0, 10, 10, 100, 100)
    marks = [one(spark, box.position(F.lit(float(x)), F.lit(float(y))))[0] for x, y in ((5, 5), (11, 5), (0, 5), (5, 10), (10, 5), (5, 0), (0, 0), (10, 10))]
    assert marks == [1, 2, 4, 8, 16, 32, 36, 24]
    identity = position.Box(0, 1, 1, 0, 1, 1)
    assert tuple(one(spark, *identity.to_pixel(F.lit(0.3), F.lit(0.6)))) == pytest.approx((0.3, 0.6))
    with pytest.raises(ValueError):
        position.Box(0, 0, 0, 1).to_pixel(F.lit(0.0), F.lit(0.0))
    wrapped = [one(spark, position.wrap_longitude(F.lit(float(v))))[0] for v in (0, 180, -180, 190, -190, 540, -540)]
    assert wrapped == [0, 180, -180, -170, 170, -180, 180]


def test_projections(spark):
    x, y = one(spark, *projections.forward("+proj=merc")(F.lit(180.0), F.lit(0.0)))
    assert x == pytest.approx(math.pi * 6378137) and y == pytest.approx(0)
    x, y = one(spark, *projections.forward("+proj=webmerc")(F.lit(0.0), F.lit(85.06)))
    assert y == pytest.approx(20048966.1, rel=1e-4)
    lon, lat = one(spark, *projections.inverse("+proj=webmerc")(*projections.forward("+proj=webmerc")(F.lit(12.5), F.lit(-33.0))))
    assert (lon, lat) == pytest.approx((12.5, -33.0))
    assert tuple(one(spark, *projections.forward("+proj=ortho")(F.lit(170.0), F.lit(0.0)))) == (None, None)
    assert projections.degrees("24W") == -24 and projections.parameters("+proj=laea +lat_0=5 +no_defs") == {"proj": "laea", "lat_0": "5", "no_defs": None}
    with pytest.raises(ValueError):
        projections.forward("+proj=wintri")
    x, y = one(spark, *projections.forward("+proj=moll")(F.lit(180.0), F.lit(0.0)))
    assert x == pytest.approx(2 * math.sqrt(2) * 6378137) and y == pytest.approx(0)


def test_text(spark):
    geom = schema.geometry(points=F.array(schema.point(F.lit(1.50), F.lit(-0.0001))))
    assert one(spark, text.wkt(geom, 2))[0] == "POINT (1.5 0)"
    both = schema.geometry(polys=F.array(F.array(ring(*SQUARE))), lines=F.array(ring((0, 0), (1, 1))))
    assert one(spark, text.wkt(both, 0))[0] == "GEOMETRYCOLLECTION (LINESTRING (0 0,1 1),POLYGON ((0 0,1 0,1 1,0 1,0 0)))"
    assert one(spark, text.wkt(schema.geometry()))[0] == "GEOMETRYCOLLECTION EMPTY"
    page = position.Box(0, 0, 1, 1, 100, 100)
    assert one(spark, text.svg_polygon(F.array(ring(*SQUARE)), page))[0] == "M0 100 100 100 100 0 0 0Z"
    assert one(spark, text.svg_line(ring((0, 0), (0.0001, 0), (1, 1)), page, 0))[0] == "M0 100 100 0"


@pytest.mark.parametrize("said", ["POINT (1 2)", "MULTIPOINT ((1 2),(3 4))", "LINESTRING (0 0,1 1,2 0)", "POLYGON ((0 0,1 0,1 1,0 0),(0.1 0.1,0.2 0.2,0.3 0.1,0.1 0.1))", "MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "GEOMETRYCOLLECTION (POINT (1 1),LINESTRING (0 0,1 1))"])
def test_codec_round_trip(spark, said):
    g = codec.from_wkb(codec.to_wkb(codec.from_wkt(F.lit(said))))
    assert one(spark, text.wkt(g, 3))[0] == said


def test_codec_refuses(spark):
    assert one(spark, codec.from_wkt(F.lit("POLYGON (1 2")))[0] is None
    assert one(spark, codec.from_wkb(F.lit(b"\x01\x02").cast("binary")))[0] is None
    assert codec.read_wkt("POINT Z (1 2 3)").points == [(1.0, 2.0)] and codec.read_wkt("POLYGON EMPTY").polys == []


def test_clip_columns(spark):
    df = spark.createDataFrame([(1, "POLYGON ((5 5,15 5,15 15,5 15,5 5))"), (2, "POLYGON ((1 1,2 1,2 2,1 1))"), (3, "POLYGON ((50 50,51 50,51 51,50 50))"), (4, None)], "id int, w string").select("id", codec.from_wkt(F.col("w")).alias("g"))
    got = df.select("id", spatial.area(spatial.polyclip(F.col("g"), Box(0, 0, 10, 10))).alias("a"), spatial.area(spatial.polycut(F.col("g"), Box(0, 0, 10, 10))).alias("b"), spatial.area(spatial.polyclip(F.col("g"), Circle(0, 0, 100))).alias("c")).orderBy("id").collect()
    assert [r["a"] for r in got] == [25, 0.5, 0, None] and [r["b"] for r in got] == [75, 0, 0.5, None] and [r["c"] for r in got] == [100, 0.5, 0.5, None]


def test_collected(spark):
    df = spark.createDataFrame([(1, "POINT (1 2)"), (1, "LINESTRING (0 0,1 1)"), (2, "POINT (5 5)")], "k int, w string").select("k", codec.from_wkt(F.col("w")).alias("g"))
    got = df.groupBy("k").agg(schema.collected(F.col("g.polys"), F.col("g.lines"), F.col("g.points")).alias("g")).orderBy("k").select(schema.geometry_type(F.col("g"))).collect()
    assert [r[0] for r in got] == ["GEOMETRYCOLLECTION", "POINT"]


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT geo_wrap_longitude(190D), geo_in_circle(1D, 0D, 0D, 0D, 1D), geo_area(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D), named_struct('x', 0D, 'y', 0D))), geo_contains(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D), named_struct('x', 0D, 'y', 0D)), 0.9D, 0.5D), geo_distance_sphere(0D, 0D, 1D, 0D)").first()
    assert r[0] == -170 and r[1] is True and r[2] == 0.5 and r[3] is True and r[4] == pytest.approx(111319.49, rel=1e-6)
