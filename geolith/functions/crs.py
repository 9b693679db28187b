"""Coordinate reference systems as tables: systems, their usages, extents and scopes; lookups, and texts that describe them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geolith.functions.ellipsoids import DATUMS, degrees, ellipsoid, parameters
from geolith.functions.projections import GEOGRAPHIC, forward_array
from geolith.functions.text import projection_parameters

# Extents (west, east, south, north) by number, and scopes by number.
EXTENTS = {
    1262: (-180.0, 180.0, -90.0, 90.0),
    1298: (-16.1, 40.18, 32.88, 84.73),
    3544: (-180.0, 180.0, -85.06, 85.06),
    3391: (-180.0, 180.0, -80.0, 84.0),
    2881: (-35.58, 44.83, 24.6, 84.73),
    1996: (-180.0, 180.0, 60.0, 90.0),
    1997: (-180.0, 180.0, -90.0, -60.0),
    1095: (19.08, 31.59, 58.84, 70.09),
    3333: (19.24, 31.59, 59.75, 70.09),
    1024: (-168.0, 180.0, -60.0, 90.0),
    3508: (-180.0, 180.0, -50.0, 50.0),
}
SCOPES = {1: "Horizontal component of 3D system.", 2: "Spatial referencing.", 3: "Web mapping and visualisation.", 4: "Very small scale conformal mapping.", 5: "Statistical analysis.", 6: "Web mapping.", 7: "Military survey.", 8: "Topographic mapping (medium scale).", 9: "Navigation and medium accuracy spatial referencing."}
# Code, name, projection string, deprecated, and usages (extent, scope).
SYSTEMS = [
    (4326, "WGS 84", "+proj=longlat +datum=WGS84 +no_defs", False, [(1262, 1)]),
    (4258, "ETRS89", "+proj=longlat +ellps=GRS80 +no_defs", False, [(1298, 2)]),
    (3857, "WGS 84 / Pseudo-Mercator", "+proj=webmerc +a=6378137 +lon_0=0 +units=m +no_defs", False, [(3544, 3)]),
    (3395, "WGS 84 / World Mercator", "+proj=merc +lon_0=0 +datum=WGS84 +units=m +no_defs", False, [(3391, 4)]),
    (3035, "ETRS89-extended / LAEA Europe", "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80 +units=m +no_defs", False, [(2881, 5)]),
    (3067, "ETRS89 / TM35FIN(E,N)", "+proj=utm +zone=35 +ellps=GRS80 +units=m +no_defs", False, [(3333, 8), (1095, 8)]),
    (4087, "WGS 84 / World Equidistant Cylindrical", "+proj=eqc +lat_ts=0 +lon_0=0 +datum=WGS84 +units=m +no_defs", False, [(3508, 6), (1262, 6)]),
    (32661, "WGS 84 / UPS North (N,E)", "+proj=stere +lat_0=90 +lon_0=0 +k_0=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84 +units=m +no_defs", False, [(1996, 7)]),
    (32761, "WGS 84 / UPS South (N,E)", "+proj=stere +lat_0=-90 +lon_0=0 +k_0=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84 +units=m +no_defs", False, [(1997, 7)]),
]


def _zones() -> list[tuple]:
    """The two series of transverse zones, by their rule, with an extent of their own each."""
    rows = []
    for south, (base, letter) in enumerate(((32600, "N"), (32700, "S"))):
        for z in range(1, 61):
            rows.append((base + z, f"WGS 84 / UTM zone {z}{letter}", f"+proj=utm +zone={z}{' +south' * south} +datum=WGS84 +units=m +no_defs", False, [(base + z, 9)]))
    return rows


def systems() -> list[tuple]:
    """All known systems, as SYSTEMS."""
    return SYSTEMS + _zones()


def extents() -> dict[int, tuple[float, float, float, float]]:
    return EXTENTS | {base + z: (6.0 * z - 186, 6.0 * z - 180, south, north) for base, south, north in ((32600, 0.0, 84.0), (32700, -80.0, 0.0)) for z in range(1, 61)}


def is_geographic(proj: str) -> bool:
    return parameters(proj).get("proj") in GEOGRAPHIC


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The seeds as tables: system (with kind projected or geodetic), usage, extent and scope."""
    known = systems()
    return {
        "system": spark.createDataFrame([(c, n, p, d, "geodetic" if is_geographic(p) else "projected") for c, n, p, d, _ in known], "srid int, name string, proj string, deprecated boolean, kind string"),
        "usage": spark.createDataFrame([(c, k, e, s) for c, _, _, _, u in known for k, (e, s) in enumerate(u)], "srid int, place int, extent int, scope int"),
        "extent": spark.createDataFrame([(k, *v) for k, v in extents().items()], "extent int, west double, east double, south double, north double"),
        "scope": spark.createDataFrame(list(SCOPES.items()), "scope int, said string"),
    }


def box_area(west: Column, east: Column, south: Column, north: Column) -> Column:
    """Square degrees of a box; one whose east is below its west crosses the antimeridian."""
    return (F.when(east < west, east + 360).otherwise(east) - west) * (north - south)


def information(system: DataFrame, usage: DataFrame, extent: DataFrame, scope: DataFrame) -> DataFrame:
    """For every code its name, string, largest extent (of equal ones the first) and that usage's scope; a code known both as projected and as geodetic is the projected one."""
    area = box_area(*map(F.col, ("west", "east", "south", "north")))
    rows = system.join(usage, "srid").join(extent, "extent").join(scope, "scope").withColumn("area", area)
    best = F.max_by(F.struct("name", "proj", "deprecated", "west", "east", "south", "north", F.col("said").alias("scope"), "area", "kind"), F.struct((F.col("kind") == "projected").alias("first"), "area", -F.col("place")))
    return rows.groupBy("srid").agg(best.alias("row")).select("srid", "row.*")


def table(spark: SparkSession) -> DataFrame:
    """srid, name, proj, area of use, scope, deprecated, params (map), is_geographic and area of the box, of every known system."""
    rows = information(**tables(spark)).drop("kind").withColumn("params", projection_parameters(F.col("proj")))
    return rows.withColumn("is_geographic", F.col("params")["proj"].isin(*GEOGRAPHIC))


def known(rows: DataFrame, spark: SparkSession, srid: str = "srid") -> DataFrame:
    """Rows whose code is a known system: a semi join."""
    return rows.join(tables(spark)["system"].select(F.col("srid").alias(srid)), srid, "left_semi")


def largest_extent(extents: DataFrame, key: str = "srid") -> DataFrame:
    """The row of the largest box of every system; boxes may cross the antimeridian."""
    kept = [c for c in extents.columns if c != key]
    return extents.groupBy(key).agg(F.max_by(F.struct(*kept), box_area(*map(F.col, ("west", "east", "south", "north")))).alias("row")).select(key, "row.*")


def projection(srid: int) -> str:
    """The projection string of a code; unknown codes raise."""
    for r in systems():
        if r[0] == srid:
            return r[2]
    raise ValueError(f"unknown reference system {srid}")


def projected_bounds(srid: int) -> tuple[float, float, float, float]:
    """Least and largest x and y of the corners of a system's largest extent (west, east, south, north in its units)."""
    _, _, proj, _, usages = next(r for r in systems() if r[0] == srid)
    boxes = [extents()[e] for e, _ in usages]
    west, east, south, north = max(boxes, key=lambda b: ((b[1] + 360 if b[1] < b[0] else b[1]) - b[0]) * (b[3] - b[2]))
    places = forward_array(proj)([(x, y) for x in (west, east) for y in (south, north)])
    return float(places[:, 0].min()), float(places[:, 0].max()), float(places[:, 1].min()), float(places[:, 1].max())


def described(srid: Column, name: Column, west: Column, east: Column, south: Column, north: Column, deprecated: Column) -> Column:
    """One line about a system."""
    return F.concat(F.format_string("EPSG:%d %s [%.2f,%.2f,%.2f,%.2f]", srid, name, west, south, east, north), F.when(deprecated, F.lit(" (deprecated)")).otherwise(F.lit("")))


# -- texts ----------------------------------------------------------------------

# Names of projections and their parameters in well-known text.
_WKT = {
    "merc": ("Mercator_1SP", ("latitude_of_origin", "central_meridian", "scale_factor")),
    "webmerc": ("Mercator_1SP", ("central_meridian", "scale_factor")),
    "tmerc": ("Transverse_Mercator", ("latitude_of_origin", "central_meridian", "scale_factor")),
    "utm": ("Transverse_Mercator", ("latitude_of_origin", "central_meridian", "scale_factor")),
    "lcc": ("Lambert_Conformal_Conic_2SP", ("latitude_of_origin", "central_meridian", "standard_parallel_1", "standard_parallel_2")),
    "laea": ("Lambert_Azimuthal_Equal_Area", ("latitude_of_center", "longitude_of_center")),
    "stere": ("Polar_Stereographic", ("latitude_of_origin", "central_meridian", "scale_factor")),
    "eqc": ("Equirectangular", ("latitude_of_origin", "central_meridian", "standard_parallel_1")),
    "aeqd": ("Azimuthal_Equidistant", ("latitude_of_center", "longitude_of_center")),
    "sinu": ("Sinusoidal", ("longitude_of_center",)),
    "moll": ("Mollweide", ("central_meridian",)),
    "ortho": ("Orthographic", ("latitude_of_origin", "central_meridian")),
    "gnom": ("Gnomonic", ("latitude_of_origin", "central_meridian")),
}


def _plain(value: float) -> str:
    return f"{value:.12g}"


def wkt(proj: str, name: str = "unknown", srid: int | None = None, simple: bool = False) -> str:
    """Well-known text of a projection string; simple: without authority and axes."""
    given = parameters(proj)
    earth = ellipsoid(given)
    datum = given.get("datum") or given.get("ellps") or ("WGS84" if not (given.get("R") or given.get("a")) else "unknown")
    code = lambda n: "" if simple or n is None else f',AUTHORITY["EPSG","{n}"]'
    flat = 0.0 if earth.f == 0 else 1 / earth.f
    base = re.sub(r" / .*", "", name) if name != "unknown" else datum
    geographic = f'GEOGCS["{base}",DATUM["{datum}",SPHEROID["{DATUMS.get(datum, datum)}",{_plain(earth.a)},{_plain(flat)}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]'
    if is_geographic(proj):
        return geographic + code(srid) + "]"
    kind = given.get("proj")
    if kind not in _WKT:
        raise ValueError(f"no well-known text of {proj}")
    value = lambda k, d=0.0: degrees(given[k]) if given.get(k) else d
    utm = kind == "utm"
    numbers = {
        "latitude_of_origin": value("lat_0"), "central_meridian": 6.0 * value("zone") - 183 if utm else value("lon_0"), "scale_factor": 0.9996 if utm else value("k_0", value("k", 1.0)),
        "latitude_of_center": value("lat_0"), "longitude_of_center": value("lon_0"), "standard_parallel_1": value("lat_1", value("lat_ts")), "standard_parallel_2": value("lat_2", value("lat_1")),
        "false_easting": 500_000.0 if utm else value("x_0"), "false_northing": 10_000_000.0 if utm and "south" in given else value("y_0"),
    }
    title, named = _WKT[kind]
    said = "".join(f',PARAMETER["{k}",{_plain(numbers[k])}]' for k in (*named, "false_easting", "false_northing"))
    axes = "" if simple else ',AXIS["Easting",EAST],AXIS["Northing",NORTH]'
    return f'PROJCS["{name}",{geographic}],PROJECTION["{title}"]{said},UNIT["metre",1]{axes}{code(srid)}]'


def pretty(text: str) -> str:
    """Well-known text with a line and an indent for each node that holds others."""
    out, depth, quoted = [], 0, False
    for k, c in enumerate(text):
        quoted ^= c == '"'
        depth += 0 if quoted else (c == "[") - (c == "]")
        out.append(c)
        if c == "," and not quoted and re.match(r"[A-Z]+\[", text[k + 1 :]):
            out.append("\n" + "    " * depth)
    return "".join(out)


def code_of(text: str) -> int | None:
    """The code in the authority of well-known text's outermost node, if it has one."""
    if not text.startswith(("PROJCS[", "GEOGCS[")):
        return None
    got = re.search(r'AUTHORITY\["[^"]*","(\d+)"\]\]$', text)
    return int(got[1]) if got else None


def texts(spark: SparkSession) -> DataFrame:
    """srid, wkt, simple_wkt, pretty_wkt, proj and epsg (the code read back from the text) of every system whose projection has a text."""
    rows = []
    for c, name, proj, _, _ in systems():
        full = wkt(proj, name, c)
        rows.append((c, full, wkt(proj, name, simple=True), pretty(full), proj, code_of(full)))
    return spark.createDataFrame(rows, "srid int, wkt string, simple_wkt string, pretty_wkt string, proj string, epsg int")
