"""WKT and WKB of geometry columns."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from geolith import schema
from geolith.operators.regions import Geometry
from geolith.operators.spatial import packed, plain

_TOKEN = re.compile(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),]")
# Type codes of well-known binary.
POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION = range(1, 8)
_ARROW = to_arrow_type(schema.GEOMETRY)


def read_wkt(text: str) -> Geometry:
    """Geometry of WKT; further coordinates than x and y go. Raises ValueError on anything else."""
    tokens = _TOKEN.findall(text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"not WKT: {text[:60]}")
    at = 0

    def take(what: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (what is not None and tokens[at] != what):
            raise ValueError(f"not WKT: {text[:60]}")
        at += 1
        return tokens[at - 1]

    def listed(item) -> list:
        if tokens[at : at + 1] and tokens[at].upper() == "EMPTY":
            take()
            return []
        take("(")
        out = [item()]
        while tokens[at : at + 1] == [","]:
            take(",")
            out.append(item())
        take(")")
        return out

    def place() -> tuple[float, float]:
        values = []
        while at < len(tokens) and re.match(r"[-+.\d]", tokens[at]):
            values.append(float(take()))
        if len(values) < 2:
            raise ValueError(f"not WKT: {text[:60]}")
        return values[0], values[1]

    def loose() -> tuple[float, float]:
        return listed(place)[0] if tokens[at : at + 1] == ["("] else place()

    def shape() -> Geometry:
        kind = take().upper()
        if tokens[at : at + 1] and tokens[at].upper() in ("Z", "M", "ZM"):
            take()
        if kind == "POINT":
            return Geometry([], [], listed(place))
        if kind == "MULTIPOINT":
            return Geometry([], [], listed(loose))
        if kind in ("LINESTRING", "LINEARRING"):
            return Geometry([], [r] if (r := listed(place)) else [], [])
        if kind == "MULTILINESTRING":
            return Geometry([], [r for r in listed(lambda: listed(place)) if r], [])
        if kind == "POLYGON":
            return Geometry([p] if (p := listed(lambda: listed(place))) else [], [], [])
        if kind == "MULTIPOLYGON":
            return Geometry([p for p in listed(lambda: listed(lambda: listed(place))) if p], [], [])
        if kind == "GEOMETRYCOLLECTION":
            parts = listed(shape)
            return Geometry(*([x for p in parts for x in p[k]] for k in range(3)))
        raise ValueError(f"not WKT: {text[:60]}")

    out = shape()
    if at != len(tokens):
        raise ValueError(f"not WKT: {text[:60]}")
    return out


def read_wkb(data: bytes) -> Geometry:
    """Geometry of well-known binary in either byte order; extended flags and further coordinates go."""
    at = 0

    def take(kind: str) -> tuple:
        nonlocal at
        size = struct.calcsize(kind)
        if at + size > len(data):
            raise ValueError("truncated WKB")
        at += size
        return struct.unpack(kind, data[at - size : at])

    def shape() -> Geometry:
        order = "<" if take("B")[0] else ">"
        code = take(order + "I")[0]
        if code & 0x20000000:
            take(order + "I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (1 if 1000 <= code & 0xFFFF < 3000 else 2 if code & 0xFFFF >= 3000 else 0)
        kind = (code & 0xFFFF) % 1000
        path = lambda: [take(f"{order}{dims}d")[:2] for _ in range(take(order + "I")[0])]
        if kind == POINT:
            p = take(f"{order}{dims}d")[:2]
            return Geometry([], [], [] if p[0] != p[0] else [p])
        if kind == LINESTRING:
            return Geometry([], [r] if (r := path()) else [], [])
        if kind == POLYGON:
            rings = [path() for _ in range(take(order + "I")[0])]
            return Geometry([rings] if rings else [], [], [])
        if MULTIPOINT <= kind <= COLLECTION:
            parts = [shape() for _ in range(take(order + "I")[0])]
            return Geometry(*([x for p in parts for x in p[k]] for k in range(3)))
        raise ValueError(f"unknown WKB type {code}")

    return shape()


def write_wkb(geom: Geometry) -> bytes:
    """Little-endian WKB in the least type that holds the parts."""
    head = lambda kind: struct.pack("<BI", 1, kind)
    path = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    parts = [(POLYGON, head(POLYGON) + struct.pack("<I", len(p)) + b"".join(map(path, p))) for p in geom.polys]
    parts += [(LINESTRING, head(LINESTRING) + path(r)) for r in geom.lines] + [(POINT, head(POINT) + struct.pack("<2d", *p)) for p in geom.points]
    if len(parts) == 1:
        return parts[0][1]
    kinds = {k for k, _ in parts}
    return head(kinds.pop() + 3 if len(kinds) == 1 else COLLECTION) + struct.pack("<I", len(parts)) + b"".join(b for _, b in parts)


def from_wkt(text: Column, srid: int = 4326) -> Column:
    """Geometry of WKT text; null and text that is no WKT give null."""

    @arrow_udf(schema.GEOMETRY)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([_or_none(read_wkt, t, srid) for t in column.to_pylist()], _ARROW)

    return run(text)


def from_wkb(data: Column, srid: int = 4326) -> Column:
    """Geometry of well-known binary; null and broken data give null."""

    @arrow_udf(schema.GEOMETRY)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([_or_none(read_wkb, d, srid) for d in column.to_pylist()], _ARROW)

    return run(data)


def _or_none(read, value, srid: int) -> dict | None:
    try:
        return None if value is None else packed(read(value), srid)
    except ValueError:
        return None


def to_wkb(geom: Column) -> Column:
    @arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else write_wkb(plain(v)) for v in column.to_pylist()], pa.binary())

    return run(geom)
