"""Projections against published control points, whole geometries within bounds, and reference systems."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.functions import crs, ellipsoids, projections
from geolith.operators import project, regions
from geolith.operators.regions import Box, Geometry, signed_area

# Published worked examples of the formulas: string, longitude, latitude, easting, northing.
CONTROL = [
    ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 5, 50, 3962799.45, 2999718.85),
    ("+proj=merc +lat_ts=42 +lon_0=51 +ellps=krass", 53, 53, 165704.29, 5171848.07),
    ("+proj=lcc +lat_1=28.3833333333333 +lat_2=30.2833333333333 +lat_0=27.8333333333333 +lon_0=-99 +x_0=609601.2192024384 +ellps=clrk66 +units=us-ft", -96, 28.5, 2963503.91, 254759.80),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50),
    ("+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84", 44, 73, 3320416.75, 632668.43),
    ("+proj=merc +datum=WGS84", 0, 60, 0.0, 8362698.55),
]
STRINGS = ["+proj=merc", "+proj=webmerc", "+proj=eqc +lat_ts=30", "+proj=sinu +lon_0=15", "+proj=moll", "+proj=laea +lat_0=52 +lon_0=10", "+proj=laea +lat_0=90", "+proj=laea +lat_0=-90 +R=6371000", "+proj=aeqd +lat_0=60 +lon_0=25", "+proj=stere +lat_0=90 +lon_0=20", "+proj=stere +lat_0=-90 +lat_ts=-71", "+proj=stere +lat_0=52 +lon_0=10", "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96", "+proj=tmerc +lon_0=27", "+proj=utm +zone=35 +south", "+proj=ob_tran +o_proj=longlat +o_lat_p=30 +o_lon_p=12 +lon_0=7"]


@pytest.mark.parametrize("case", CONTROL)
def test_control_points(case):
    string, lon, lat, x, y = case
    assert projections.forward_array(string)([(lon, lat)])[0].tolist() == pytest.approx([x, y], abs=0.02)
    assert projections.inverse_array(string)([(x, y)])[0].tolist() == pytest.approx([lon, lat], abs=1e-6)


@pytest.mark.parametrize("string", STRINGS)
def test_there_and_back_in_both_forms(spark, string):
    rng = np.random.default_rng(1)
    near = "tmerc" in string or "utm" in string
    places = np.stack([rng.uniform(*((7, 47) if near else (-179, 179)), 200), rng.uniform(-85, 85, 200)], axis=1)
    there = projections.forward_array(string)(places)
    back = projections.inverse_array(string)(there)
    off = np.abs(back - places)
    assert np.minimum(off[:, 0], np.abs(360 - off[:, 0])).max() < 1e-6 and off[:, 1].max() < 1e-6
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places[:40])], "k long, x double, y double")
    x, y = projections.forward(string)(F.col("x"), F.col("y"))
    u, v = projections.inverse(string)(F.col("u"), F.col("v"))
    rows = df.select("k", "x", "y", x.alias("u"), y.alias("v")).select("k", "u", "v", u.alias("lon"), v.alias("lat")).orderBy("k").collect()
    assert np.allclose([(r["u"], r["v"]) for r in rows], there[:40], rtol=1e-9, atol=1e-6)
    assert max(min(abs(r["lon"] - p[0]), 360 - abs(r["lon"] - p[0])) for r, p in zip(rows, places)) < 1e-6


def test_unseen_places_and_names():
    f = projections.forward_array("+proj=ortho +lat_0=0 +lon_0=0")
    assert np.isnan(f([(180.0, 0.0)])).all() and np.isnan(projections.forward_array("+proj=merc")([(0.0, 90.0)])).all()
    with pytest.raises(ValueError):
        projections.forward("+proj=utm +zone=61")
    with pytest.raises(ValueError):
        ellipsoids.named("nowhere")
    assert ellipsoids.named("OSGB36") == ellipsoids.named("airy") and ellipsoids.named("FMI") == (6371229.0, 0.0)
    assert len(ellipsoids.ELLIPSOIDS) == 43


def test_systems_and_texts(spark):
    assert crs.projected_bounds(3857)[1] == pytest.approx(20037508.34, abs=0.01)
    for srid in (3067, 3035, 32735, 4326):
        said = crs.wkt(crs.projection(srid), "name", srid)
        assert crs.code_of(said) == srid and crs.code_of(crs.wkt(crs.projection(srid), simple=True)) is None
        assert "".join(crs.pretty(said).split()) == "".join(said.split()) and "\n" in crs.pretty(said)
    assert crs.code_of("LOCAL_CS[]") is None
    rows = {r["srid"]: r for r in crs.information(**crs.tables(spark)).where("srid in (3067, 4087)").collect()}
    assert rows[3067]["west"] == 19.08 and rows[4087]["north"] == 90.0


def ring(*corners):
    return [*map(lambda p: (float(p[0]), float(p[1])), corners), (float(corners[0][0]), float(corners[0][1]))]


WORLD = ring((-180, -90), (180, -90), (180, 90), (-180, 90))


def areas(geom):
    return sum(signed_area(r) for p in geom.polys for r in p)


def checked(geom, bounds):
    """Rings are closed and within bounds, exteriors counter-clockwise and holes clockwise, without repeated vertices."""
    x1, y1, x2, y2 = bounds
    for p in geom.polys:
        for k, r in enumerate(p):
            assert r[0] == r[-1] and (signed_area(r) > 0) == (k == 0)
            assert all(x1 - 1 <= x <= x2 + 1 and y1 - 1 <= y <= y2 + 1 for x, y in r)
            assert all(a != b for a, b in zip(r[:-1], r[1:]))
    return geom


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("string", ["+proj=webmerc", "+proj=eqc", "+proj=merc", "+proj=sinu", "+proj=moll", "+proj=laea +lat_0=52 +lon_0=10", "+proj=stere +lat_0=90", "+proj=aeqd +lat_0=60 +lon_0=25", "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39"])
def test_the_whole_world(string, turned):
    bounds = (-3e6, -3e6, 3e6, 3e6)
    world = Geometry([[WORLD[::-1] if turned else WORLD]], [], [])
    got = checked(project.project(world, projections.forward_array(string), bounds), bounds)
    assert areas(got) > 0.9 * 36e12


@pytest.mark.parametrize("string", ["+proj=stere +lat_0=90", "+proj=laea +lat_0=90", "+proj=aeqd +lat_0=90"])
def test_polar_caps(string):
    cap = ring(*[(lon, 60) for lon in range(-180, 181, 5)], (180, 90), (-180, 90))
    bounds = (-6e6, -6e6, 6e6, 6e6)
    got = checked(project.project(Geometry([[cap]], [], []), projections.forward_array(string), bounds), bounds)
    radius = abs(projections.forward_array(string)([(0.0, 60.0)])[0][1])
    assert areas(got) == pytest.approx(math.pi * radius**2, rel=0.02)


def test_polygons_that_fail_in_places():
    """A polygon half beyond the horizon ends there, at the bounds, and not in a chord."""
    bounds = (-5e6, -5e6, 5e6, 5e6)
    wide = ring((-60, -20), (150, -20), (150, 20), (-60, 20))
    got = checked(project.project(Geometry([[wide]], [], []), projections.forward_array("+proj=ortho +lat_0=0 +lon_0=0"), bounds), bounds)
    south = 6378137 * math.sin(math.radians(20))
    assert areas(got) == pytest.approx(1e7 * 2 * south, rel=0.02)
    hole = Geometry([[ring((-20, -20), (20, -20), (20, 20), (-20, 20)), ring((-5, -5), (-5, 5), (5, 5), (5, -5))]], [], [])
    whole = checked(project.project(hole, projections.forward_array("+proj=laea +lat_0=0 +lon_0=0"), bounds), bounds)
    assert [len(p) for p in whole.polys] == [2]
    with pytest.raises(ValueError):
        project.project(hole, projections.forward_array("+proj=merc"), (0, 0, 0, 0))


def test_lines_break_at_jumps():
    line = Geometry([], [[(170.0, 10.0), (179.0, 10.0), (-179.0, 10.0), (-170.0, 10.0)]], [])
    got = project.project(line, projections.forward_array("+proj=eqc"), (-2.1e7, -1e7, 2.1e7, 1e7), densify_km=0.0, jump_km=2000.0)
    assert len(got.lines) == 2
    assert project.project(Geometry([], [], [(0.0, 0.0), (0.0, 89.9)]), projections.forward_array("+proj=webmerc"), (-1e6, -1e6, 1e6, 1e6)).points[0] == pytest.approx((0.0, 0.0), abs=1e-6)


def test_discs():
    assert len(project.circle_parts(0.0, 0.0, 1e6)) == 1 and len(project.circle_parts(179.0, 0.0, 1e6)) == 2
    around = project.circle_parts(30.0, 85.0, 2e6, 72)
    assert sum(abs(signed_area(p[0])) for p in around) == pytest.approx(abs(signed_area(project.circle(30.0, 85.0, 2e6, 72))), rel=1e-9)
    assert max(y for p in around for _, y in p[0]) == 90.0
    assert min(y for _, y in project.circle(0.0, -85.0, 2e6)) == -90.0
    assert project.envelope("+proj=merc +lon_0=20") == (-160.0, 200.0, -90.0, 90.0) and project.envelope("+proj=laea") is None
    assert project.envelope("+proj=longlat +lon_wrap=180")[:2] == (0.0, 360.0) and project.spans_longitudes(-10, 10, -5, 10)


def test_fragments_along_a_box():
    box = Box(0, 0, 10, 10)
    assert regions.oriented([[(0.0, 2.0), (3.0, 5.0), (0.0, 8.0)]], box) == [[(0.0, 8.0), (3.0, 5.0), (0.0, 2.0)]]
    assert regions.oriented([[(0.0, 8.0), (3.0, 5.0), (0.0, 2.0)]], box) == [[(0.0, 8.0), (3.0, 5.0), (0.0, 2.0)]]
    assert regions.oriented([[(4.0, 0.0), (3.0, 3.0), (0.0, 4.0)]], box)[0][0] == (0.0, 4.0)
    assert regions.oriented([[(0.0, 4.0), (5.0, 5.0), (10.0, 4.0)]], box)[0][0] == (0.0, 4.0)
    eight = ring((0, 0), (1, 0), (1, 1), (3, 1), (3, 3), (1, 3), (1, 1), (0, 1))
    parts = regions.simple_rings(eight)
    assert sorted(abs(signed_area(r)) for r in parts) == [1, 4] and all(len(set(r)) == len(r) - 1 for r in parts)
    assert regions.split_at([[(0, 0), (1, 1), (2, 2)]], {(1, 1)}) == [[(0, 0), (1, 1)], [(1, 1), (2, 2)]]
    touch = regions.clip_line([(-10.0, 5.0), (10.0, 5.0)], regions.Circle(0, 0, 5), False)
    assert touch == [[(-10.0, 5.0), (10.0, 5.0)]] and regions.clip_line([(-10.0, 5.0), (10.0, 5.0)], regions.Circle(0, 0, 5), True) == []
