"""SQL names for the operators: after ``register(spark)`` they work in spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Expressions of SQL functions; the bodies are Spark SQL and take part in code generation.
_BODIES = {
    "geo_wrap_longitude(lon DOUBLE) RETURNS DOUBLE": "CASE WHEN lon > 180 THEN (lon + 180) % 360 - 180 WHEN lon < -180 THEN 180 - (180 - lon) % 360 ELSE lon END",
    "geo_distance_sphere(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE": "2 * 6378137D * asin(least(1D, sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))",
    "geo_in_circle(x DOUBLE, y DOUBLE, cx DOUBLE, cy DOUBLE, r DOUBLE) RETURNS BOOLEAN": "(x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r",
    "geo_area(ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) RETURNS DOUBLE": "abs(aggregate(sequence(1, greatest(1, size(ring) - 1)), 0D, (a, i) -> a + coalesce(get(ring, i - 1).x * get(ring, i).y - get(ring, i).x * get(ring, i - 1).y, 0D))) / 2",
    "geo_contains(ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, px DOUBLE, py DOUBLE) RETURNS BOOLEAN": "aggregate(sequence(1, greatest(1, size(ring) - 1)), false, (a, i) -> a <> coalesce((get(ring, i - 1).y > py) <> (get(ring, i).y > py) AND px < (get(ring, i).x - get(ring, i - 1).x) * (py - get(ring, i - 1).y) / (get(ring, i).y - get(ring, i - 1).y) + get(ring, i - 1).x, false))",
}


def register(spark: SparkSession) -> None:
    """Create the temporary SQL functions of this session."""
    for head, body in _BODIES.items():
        name, _, returns = head.partition(" RETURNS ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {returns} RETURN {body}")
