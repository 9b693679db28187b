import math

import pytest
from pyspark.sql import functions as F

from geolith import schema
from geolith.functions import crs
from geolith.operators import project, spatial
from geolith.operators.regions import Geometry, signed_area
from geolith.operators.triangulation import buffer, overlay, union


def square(x, y, s):
    return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]


def area(polys):
    return sum(signed_area(r) for p in polys for r in p)


def test_overlay():
    a, b = [square(0.0, 0.0, 2.0)], [square(1.0, 1.0, 2.0)]
    assert [area(overlay(a, b, how)) for how in ("intersection", "difference", "union")] == pytest.approx([1, 3, 7])
    assert area(overlay([square(0.0, 0.0, 3.0)], [square(1.0, 1.0, 1.0)], "difference")) == pytest.approx(8)
    assert overlay(a, [square(9.0, 9.0, 1.0)], "intersection") == [] and union([]) == []
    assert area(union([square(0.0, 0.0, 1.0), square(0.5, 0.0, 1.0), square(1.0, 0.0, 1.0)])) == pytest.approx(2)


def test_buffer():
    assert signed_area(buffer([(3.0, 4.0)], 2.0)[0]) == pytest.approx(4 * math.pi, rel=2e-3)
    bent = buffer([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 1.0)
    assert len(bent) == 1 and signed_area(bent[0]) == pytest.approx(39 + 1.25 * math.pi, rel=1e-3)


def test_transform():
    across = Geometry([[[(170.0, 0.0), (179.9, 0.0), (179.9, 10.0), (170.0, 10.0), (170.0, 0.0)]]], [], [])
    got = project.transform(across, "+proj=eqc", (-2.1e7, -1e7, 2.1e7, 1e7))
    assert area(got.polys) == pytest.approx(math.radians(9.9) * math.radians(10) * 6378137**2)
    assert project.transform(Geometry([], [], [(180.0, 0.0)]), "+proj=ortho", (-1e7, -1e7, 1e7, 1e7)) is None
    with pytest.raises(ValueError):
        project.forward_array("+proj=wintri")
    for name in ("merc", "webmerc", "eqc", "sinu", "laea", "aeqd", "stere", "ortho", "gnom"):
        place = project.forward_array(f"+proj={name} +lon_0=10 +lat_0=90" if name == "stere" else f"+proj={name} +lon_0=10")([(10.0, 90.0 if name == "stere" else 0.0)])[0]
        assert tuple(place) == pytest.approx((0, 0), abs=1e-6)


def test_columns(spark):
    line = F.array(schema.point(F.lit(0.0), F.lit(0.0)), schema.point(F.lit(1.0), F.lit(0.0)))
    wide = spark.range(1).select(spatial.area(spatial.expand(schema.geometry(lines=F.array(line)), 10_000.0))).first()[0]
    degree = math.radians(1) * 6378137
    assert wide == pytest.approx((20_000 * degree + math.pi * 1e8) / degree**2, rel=1e-2)


def test_systems(spark):
    rows = {r["srid"]: r for r in crs.table(spark).collect()}
    assert rows[4326]["is_geographic"] and rows[3035]["params"]["proj"] == "laea" and rows[3857]["area"] == pytest.approx(360 * 170.12)
    assert crs.projection(3035).startswith("+proj=laea")
    with pytest.raises(ValueError):
        crs.projection(1)
    boxes = spark.createDataFrame([(1, 170.0, -170.0, 0.0, 10.0), (1, 0.0, 10.0, 0.0, 10.0)], "srid int, west double, east double, south double, north double")
    assert crs.largest_extent(boxes).first()["west"] == 170.0
    said = crs.table(spark).where("srid = 4326").select(crs.described(*map(F.col, ("srid", "name", "west", "east", "south", "north", "deprecated")))).first()[0]
    assert said == "EPSG:4326 WGS 84 [-180.00,-90.00,180.00,90.00]"
