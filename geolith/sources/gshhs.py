"""Binary shoreline polygons as a data source, and their filters as columns.

A record is a 36-byte header (id, vertices, level, west, east, south, north in
microdegrees, area in tenths of km2, then two 16-bit flags) and its vertices as
pairs of 32-bit microdegrees, in either byte order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geolith.functions import metrics

_KM_PER_DEGREE = 111.32
SCHEMA = "id int, n int, level int, west double, east double, south double, north double, area_km2 double, greenwich boolean, ring array<struct<x double, y double>>, length_km double"


def header_filter(level: Column, area_km2: Column, most_level: int = 4, least_island: float = 0.0, least_lake: float = 0.0) -> Column:
    """Levels up to one, and areas from a limit on; even levels are lakes."""
    return (level <= most_level) & (area_km2 >= F.when(level % 2 == 0, F.lit(least_lake)).otherwise(F.lit(least_island)))


def flat_length_km(ring: Column) -> Column:
    """Length of a ring with degrees of longitude shortened by the edge's middle latitude."""
    return metrics._edges(ring, lambda a, b: F.sqrt(F.pow((b["x"] - a["x"]) * _KM_PER_DEGREE * F.cos(F.radians((a["y"] + b["y"]) / 2)), 2) + F.pow((b["y"] - a["y"]) * _KM_PER_DEGREE, 2)))


def keeps_shape(level: Column, roundness: Column, least: float) -> Column:
    """Roundness 4 pi A / L^2 is asked of lakes and what lies in them alone."""
    return (level < 2) | (roundness >= least)


class Wanted(NamedTuple):
    """What headers must say for a record's points to be read."""

    most_level: int = 4
    least_island: float = 0.0
    least_lake: float = 0.0
    window: tuple[float, float, float, float] | None = None  # west, east, south, north

    def __call__(self, level: int, area_km2: float, west: float, east: float, south: float, north: float) -> bool:
        if level > self.most_level or area_km2 < (self.least_lake if level % 2 == 0 else self.least_island):
            return False
        if self.window is None:
            return True
        w, e, s, n = self.window
        far, own = (e + 360 if e < w else e), (east + 360 if east < west else east)
        return south <= n and north >= s and any(west + turn <= far and own + turn >= w for turn in (0, 360, -360))


def parse(data: bytes, wanted: Wanted = Wanted()) -> Iterator[tuple]:
    """Rows of SCHEMA whose headers are wanted; the points of others are stepped over. Raises ValueError where a record breaks off or no byte order fits."""
    at, order = 0, ""
    while at < len(data):
        if at + 36 > len(data):
            raise ValueError("truncated shoreline header")
        if not order:
            order = next((o for o in "><" if 1 <= struct.unpack_from(f"{o}i", data, at + 8)[0] & 255 <= 4), "")
            if not order:
                raise ValueError("not a shoreline file")
        ident, n, level, west, east, south, north, area, greenwich = struct.unpack_from(f"{order}8ih", data, at)
        end = at + 36 + 8 * n
        if n < 0 or end > len(data):
            raise ValueError("truncated shoreline record")
        level, area = level & 255, area / 10
        box = west / 1e6, east / 1e6, south / 1e6, north / 1e6
        if wanted(level, area, *box):
            xy = np.frombuffer(data, f"{order}i4", 2 * n, at + 36).reshape(-1, 2) / 1e6
            lon = np.where((bool(greenwich) & (xy[:, 0] > box[1])) | (xy[:, 0] > 180), xy[:, 0] - 360, xy[:, 0]) if n else xy[:, 0]
            step = np.hypot(np.diff(lon) * _KM_PER_DEGREE * np.cos(np.radians((xy[1:, 1] + xy[:-1, 1]) / 2)), np.diff(xy[:, 1]) * _KM_PER_DEGREE)
            yield ident, n, level, *box, area, bool(greenwich), np.stack([lon, xy[:, 1]], axis=1), float(step.sum())
        at = end


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    *plain, rings, lengths = zip(*rows, strict=True)
    places = np.concatenate([np.zeros((0, 2)), *rings])
    points = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], names=["x", "y"])
    offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in rings])].astype(np.int32))
    columns = [pa.array(v, kind.field(k).type) for k, v in enumerate(plain)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, points), pa.array(lengths, pa.float64())], names=kind.names)


def read(spark: SparkSession, path: str, most_level: int = 4, least_island: float = 0.0, least_lake: float = 0.0, least_roundness: float = 0.0, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Polygons of all shoreline files under a path, filtered by header (level, area, window of west, east, south, north) and roundness."""
    wanted = Wanted(most_level, least_island, least_lake, window)
    kind = pa.schema([("id", pa.int32()), ("n", pa.int32()), ("level", pa.int32()), *[(n, pa.float64()) for n in ("west", "east", "south", "north", "area_km2")], ("greenwich", pa.bool_()), ("ring", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("length_km", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                held = []
                for row in parse(content, wanted):
                    held.append(row)
                    if len(held) == 256:
                        yield _batch(held, kind)
                        held = []
                if held:
                    yield _batch(held, kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    out = files.mapInArrow(rows, SCHEMA)
    return out.where(keeps_shape(F.col("level"), metrics._ratio(F.col("area_km2"), F.col("length_km")), least_roundness)) if least_roundness > 0 else out
