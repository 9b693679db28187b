"""Elevation and land-cover lookup in tables of raster cells.

Cells are (level_size, tile_lon, tile_lat, cell_i, cell_j, value): tiles of one
degree with level_size cells a side, rows from south to north. A point takes the
value of the cell it lies in, of the finest level that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MISSING = -32768

# Land-cover classes that matter to lookups.
LAKES, NO_DATA, SEA, CASPIAN_SEA = 210, 230, 240, 241


def cell_of(lon: Column, lat: Column, size: Column) -> dict[str, Column]:
    """Key of the cell that holds a point, for a level of size cells a side."""
    width = 1.0 / size
    x = F.when(lon >= 180, lon - 360).otherwise(lon) + 180
    y = F.least(lat, 90 - width / 2) + 90
    return {"tile_lon": (F.floor(x) - 180).cast("int"), "tile_lat": (F.floor(y) - 90).cast("int"), "cell_i": ((x - F.floor(x)) / width).cast("int"), "cell_j": ((y - F.floor(y)) / width).cast("int")}


def limit_of(resolution_km: float) -> int:
    """Cells a side of a level that is fine enough."""
    return int(3600 * 30 / (1000 * resolution_km))


def levels_for(sizes: list[int], resolution_km: float = 0.0) -> list[int]:
    """Level sizes to probe, finest first: from the coarsest that is fine enough, or the finest, on."""
    ordered = sorted(sizes, reverse=True)
    if not ordered or resolution_km == 0:
        return ordered
    if resolution_km < 0:
        raise ValueError("a resolution cannot be negative")
    limit = limit_of(resolution_km)
    coarse = next((k for k, s in enumerate(ordered) if s < limit), len(ordered))
    return ordered[max(0, coarse - 1) :]


def _probed(points: DataFrame, cells: DataFrame, sizes: list[int], lon: str, lat: str, bad: Column) -> DataFrame:
    """points with value_k and tile_k (whether level k has the tile) for every level. One equi-join a level, on the cell's key."""
    out = points
    for k, size in enumerate(sizes):
        level = cells.where(F.col("level_size") == size)
        key = cell_of(F.col(lon), F.col(lat), F.lit(size))
        tiles = level.select("tile_lon", "tile_lat").distinct().withColumn(f"tile_{k}", F.lit(True))
        values = level.select("tile_lon", "tile_lat", "cell_i", "cell_j", F.when(~bad, F.col("value")).alias(f"value_{k}"))
        out = out.withColumns(key).join(tiles, ["tile_lon", "tile_lat"], "left").join(values, ["tile_lon", "tile_lat", "cell_i", "cell_j"], "left").drop("tile_lon", "tile_lat", "cell_i", "cell_j")
    return out


def elevation(points: DataFrame, cells: DataFrame, sizes: list[int], lon: str = "lon", lat: str = "lat", resolution_km: float = 0.0) -> DataFrame:
    """points with elevation: the first level's value that is no gap. Where the last level probed has no tile it is sea, 0; where it has a gap, null. Points outside the globe get null."""
    probe = levels_for(sizes, resolution_km)
    found = _probed(points, cells, probe, lon, lat, F.col("value") == MISSING)
    first = F.coalesce(*[F.col(f"value_{k}") for k in range(len(probe))], F.lit(None).cast("int"))
    sea = F.col(f"tile_{len(probe) - 1}").isNull() if probe else F.lit(True)
    on_globe = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    return found.select(*points.columns, F.when(on_globe, F.coalesce(first, F.when(sea, F.lit(0)))).cast("int").alias("elevation"))


def cover(points: DataFrame, cells: DataFrame, sizes: list[int], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with their land-cover class: the first level's that has data, else sea."""
    probe = levels_for(sizes)
    found = _probed(points, cells, probe, lon, lat, F.col("value").isin(MISSING, NO_DATA))
    on_globe = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    return found.select(*points.columns, F.when(on_globe, F.coalesce(*[F.col(f"value_{k}") for k in range(len(probe))], F.lit(SEA))).cast("int").alias("cover"))


def is_open_water(cover_class: Column) -> Column:
    return cover_class.isin(LAKES, SEA, CASPIAN_SEA)
