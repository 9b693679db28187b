"""Elevation and land-cover tiles (.hgt) as a table of raster cells.

A tile covers one degree from the south-west corner its name gives; it holds
N x N big-endian 16-bit values, rows from north to south. Cells come out with
rows counted from the south, as ``operators.raster`` looks them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

NAME = r"([NS])(\d{2})([EW])(\d{3})[^/]*\.hgt$"
SCHEMA = "level_size int, tile_lon int, tile_lat int, cell_i int, cell_j int, value int"


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """path, tile_lon, tile_lat, size and content of every valid tile below a path: named by its corner, of 2 * N * N bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hgt").load(path)
    part = lambda k: F.regexp_extract("path", NAME, k)
    corner = lambda sign, digits, minus: F.when(part(sign) == minus, -part(digits).try_cast("int")).otherwise(part(digits).try_cast("int"))
    size = F.floor(F.sqrt(F.col("length") / 2) + 0.5).cast("int")
    named = files.where(F.col("path").rlike(NAME)).select("path", "length", "content", corner(3, 4, "W").alias("tile_lon"), corner(1, 2, "S").alias("tile_lat"), size.alias("size"))
    return named.where((F.col("size") > 0) & (F.col("length") == 2 * F.col("size") * F.col("size"))).drop("length")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all tiles. A tile's last row and column, which the next tile repeats, stay."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lon, lat, n, content in zip(*(b.column(c).to_pylist() for c in ("tile_lon", "tile_lat", "size", "content")), strict=True):
                grid = np.frombuffer(content, ">i2").reshape(n, n)[::-1].astype(np.int32)
                for at in range(0, n, 64):
                    rows = grid[at : at + 64]
                    j, i = np.divmod(np.arange(rows.size, dtype=np.int32), n)
                    whole = lambda v: pa.array(np.full(rows.size, v, np.int32))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([whole(n), whole(lon), whole(lat), pa.array(i.astype(np.int32)), pa.array((j + at).astype(np.int32)), pa.array(rows.ravel())], names=["level_size", "tile_lon", "tile_lat", "cell_i", "cell_j", "value"])

    return tiles(spark, path).drop("path").mapInArrow(cells, SCHEMA)
