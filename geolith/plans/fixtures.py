"""Geometry derived from the plain tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from geolith.functions import metrics
from geolith.schema import point

_LON = "((l_orderkey * 7919 + l_linenumber * 104729) % 36000) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE)"
_LAT = "((l_partkey * 6151 + l_suppkey * 3) % 17000) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE)"
_TILE_X = "(n_nationkey % 5) * CAST(72 AS DOUBLE) - CAST(180 AS DOUBLE)"
_TILE_Y = "floor(n_nationkey / CAST(5 AS DOUBLE)) * CAST(34 AS DOUBLE) - CAST(85 AS DOUBLE)"
_CIRCLE_X = "((s_suppkey * 7919) % 36000) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE)"
_CIRCLE_Y = "((s_suppkey * 6151) % 17000) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE)"
_STAR_X = "(vec_id % 20) * CAST(18 AS DOUBLE) - CAST(171 AS DOUBLE)"
_STAR_Y = "(CAST(floor(vec_id / CAST(20 AS DOUBLE)) AS BIGINT) % 10) * CAST(17 AS DOUBLE) - CAST(76 AS DOUBLE)"
_PART_X = "CAST((p_partkey * 37) % 1009 AS DOUBLE)"
_PART_Y = "CAST((p_partkey * p_partkey * 13) % 991 AS DOUBLE)"
_WEST = "((o_orderkey * 7919) % 36000) / CAST(100 AS DOUBLE) - CAST(181 AS DOUBLE)"
_MID = "((o_orderkey * 6151) % 17000) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE)"


def _raster(cells: int, side: int, value: str) -> tuple[str, ...]:
    """Tile, cell and value of a part in a level of tiles with so many cells, fifteen tiles to a row."""
    n = f"floor(p_partkey / CAST({cells} AS DOUBLE))"
    return f"{n} % 15", f"floor({n} / 15)", f"p_partkey % {side}", f"floor((p_partkey % {cells}) / CAST({side} AS DOUBLE))", value


_CELL = ("tile_lon", "tile_lat", "cell_i", "cell_j", "value")
_FINE = _raster(1600, 40, "CASE WHEN p_partkey % 17 = 0 THEN -32768 ELSE p_size END")
_COARSE = _raster(100, 10, "CASE WHEN p_partkey % 23 = 0 THEN -32768 ELSE 100 + p_size END")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows that are small to read and long to work on, dealt to at least as many tasks as run at once."""
    return df.repartition(max(1, 2 * df.sparkSession.sparkContext.defaultParallelism))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lon/lat point for every line item."""
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_LON).alias("x"), F.expr(_LAT).alias("y"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple 64-cornered polygon for every embedding: polygon, ring, box and label."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(_STAR_X).alias("cx"), F.expr(_STAR_Y).alias("cy"), F.transform("embedding", lambda e: e.cast("double")).alias("e"))
    angle = lambda i: 2 * math.pi * i.cast("double") / 64.0
    corner = lambda e, i: point(F.col("cx") + (2.0 + 3.0 * F.abs(e)) * F.cos(angle(i)), F.col("cy") + (2.0 + 3.0 * F.abs(e)) * F.sin(angle(i)))
    open_ = F.transform("e", corner)
    out = t.select("vec_id", "label", open_.alias("open")).select("vec_id", "label", F.concat("open", F.slice("open", 1, 1)).alias("ring"))
    return out.select("vec_id", "label", "ring", F.array("ring").alias("polygon"), metrics.envelope(F.col("ring")).alias("box"))


def square(x0, y0, side):
    """A counter-clockwise closed ring of a square from its lower left corner."""
    return F.array(point(x0, y0), point(x0 + side, y0), point(x0 + side, y0 + side), point(x0, y0 + side), point(x0, y0))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_TILE_X).alias("x0"), F.expr(_TILE_Y).alias("y0"))


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_CIRCLE_X).alias("cx"), F.expr(_CIRCLE_Y).alias("cy"), (1 + F.col("s_suppkey") % 7).cast("double").alias("r"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square for every part, with its envelope."""
    t = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.expr(_PART_X).alias("x0"), F.expr(_PART_Y).alias("y0"), F.expr("p_size / CAST(10 AS DOUBLE)").alias("side"))
    box = F.struct(F.col("x0").alias("west"), (F.col("x0") + F.col("side")).alias("east"), F.col("y0").alias("south"), (F.col("y0") + F.col("side")).alias("north"))
    return t.withColumn("box", box)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of a line for every user: user_id, idx, x, y in the order of time."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("idx"), F.col("value").cast("double").alias("x"), F.expr("CAST(event_id % 180 - 90 AS DOUBLE)").alias("y"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raster levels over all parts: a fine one of tiles with 40 cells a side, with gaps, and a coarse one of tiles with 10."""
    t = table(spark, sf_dir, "part")
    fine = t.select(F.lit(40).alias("level_size"), *[F.expr(f"CAST({e} AS INT)").alias(n) for n, e in zip(_CELL, _FINE, strict=True)])
    wide = t.select(F.lit(10).alias("level_size"), *[F.expr(f"CAST({e} AS INT)").alias(n) for n, e in zip(_CELL, _COARSE, strict=True)])
    return fine.unionAll(wide)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within and around the raster, for every order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("((o_orderkey * 7919) % 16200) / CAST(1000 AS DOUBLE) - CAST(0.6 AS DOUBLE)").alias("lon"), F.expr("((o_orderkey * 6151) % 2700) / CAST(1000 AS DOUBLE) - CAST(0.3 AS DOUBLE)").alias("lat"))


def shores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shoreline header for every order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST(o_orderkey % 4 + 1 AS INT)").alias("level"), F.expr("round(o_totalprice / CAST(10 AS DOUBLE), 6)").alias("area_km2"), F.expr(_WEST).alias("west"), F.expr(f"{_WEST} + CAST(2 AS DOUBLE)").alias("east"), F.expr(f"{_MID} - CAST(1 AS DOUBLE)").alias("south"), F.expr(f"{_MID} + CAST(1 AS DOUBLE)").alias("north"))


_ANGLE = "CAST(2 AS DOUBLE) * pi() * CAST({i} AS DOUBLE) / CAST(64 AS DOUBLE)"
_I = "((i - 1) % 64)"
SQL = {
    "points": f"points AS (SELECT l_orderkey, l_linenumber, l_quantity, {_LON} AS x, {_LAT} AS y FROM lineitem)",
    "verts": f"verts AS (SELECT vec_id, label, i - 1 AS idx, {_STAR_X} + (2 + 3 * abs(CAST(embedding[{_I} + 1] AS DOUBLE))) * cos({_ANGLE.format(i=_I)}) AS x, {_STAR_Y} + (2 + 3 * abs(CAST(embedding[{_I} + 1] AS DOUBLE))) * sin({_ANGLE.format(i=_I)}) AS y FROM (SELECT vec_id, label, embedding, unnest(range(1, 66)) AS i FROM embeddings))",
    "edges": "edges AS (SELECT a.vec_id, a.idx, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM verts a JOIN verts b ON a.vec_id = b.vec_id AND b.idx = a.idx + 1)",
    "tiles": f"tiles AS (SELECT n_nationkey, {_TILE_X} AS x0, {_TILE_Y} AS y0 FROM nation)",
    "circles": f"circles AS (SELECT s_suppkey, {_CIRCLE_X} AS cx, {_CIRCLE_Y} AS cy, CAST(1 + s_suppkey % 7 AS DOUBLE) AS r FROM supplier)",
    "boxes": f"boxes AS (SELECT p_partkey, {_PART_X} AS x0, {_PART_Y} AS y0, p_size / CAST(10 AS DOUBLE) AS side FROM part)",
    "traj": "traj AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, CAST(value AS DOUBLE) AS x, CAST(event_id % 180 - 90 AS DOUBLE) AS y FROM events)",
    "cells": "cells AS (SELECT 40 AS level_size, " + ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in zip(_CELL, _FINE, strict=True)) + " FROM part UNION ALL SELECT 10, " + ", ".join(f"CAST({e} AS INT)" for e in _COARSE) + " FROM part)",
    "probes": "probes AS (SELECT o_orderkey, ((o_orderkey * 7919) % 16200) / CAST(1000 AS DOUBLE) - CAST(0.6 AS DOUBLE) AS lon, ((o_orderkey * 6151) % 2700) / CAST(1000 AS DOUBLE) - CAST(0.3 AS DOUBLE) AS lat FROM orders)",
    "shores": f"shores AS (SELECT o_orderkey, CAST(o_orderkey % 4 + 1 AS INT) AS level, round(o_totalprice / CAST(10 AS DOUBLE), 6) AS area_km2, {_WEST} AS west, {_WEST} + 2 AS east, {_MID} - 1 AS south, {_MID} + 1 AS north FROM orders)",
}


def with_(*names: str) -> str:
    """A WITH clause of the named fixtures."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
