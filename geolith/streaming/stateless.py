"""Point operators on streams. None keeps state, so each works on readStream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geolith.functions.position import Box
from geolith.operators.joins import points_in_polygons
from geolith.operators.raster import elevation


def positions(stream: DataFrame, box: Box, x: str = "x", y: str = "y") -> DataFrame:
    """The stream with each point's position against a box."""
    return stream.withColumn("position", box.position(F.col(x), F.col(y)))


def within(stream: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points of a stream with the polygons of a table that hold them: a join of the stream with a table, cell by cell."""
    return points_in_polygons(stream, polygons, size, x, y)


def heights(stream: DataFrame, cells: DataFrame, sizes: list[int], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points of a stream with their elevation."""
    return elevation(stream, cells, sizes, lon, lat)


def counts_by_time(stream: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts of a stream in windows of time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count(F.lit(1)).alias("n"))
