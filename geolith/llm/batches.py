"""Shared plumbing: bounded Arrow batches and text buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows in an Arrow batch; with documents of 20,000 words this stays near 60 MB.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Arrow batch carries to a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def text_of(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads; other columns, clashing names included, go."""
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), *[F.col(f"`{c}`") for c in more])


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, with the start and end of each; null is empty."""
    n = len(column)
    if not n:
        zero = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), zero, zero
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
