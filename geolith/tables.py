"""Tables written in the folder that driver and executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error, as executors would write to their own disks."""
    where = spark.conf.get(_KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='geolith-')}"
        spark.conf.set(_KEY, where)
    return where.rstrip("/")


def materialised(df: DataFrame, compression: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """df written once as Parquet and read again. The table goes with ``dropped``, or when the interpreter ends. group_bytes: of a row group, which a writer holds in memory."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geolith-{uuid.uuid4().hex}"
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path, compression=compression)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geolith_path = path
    return out


def few(df: DataFrame) -> DataFrame:
    """df in at most as many partitions as tasks run at once, for small tables: each file costs a process and a request. No shuffle; what is computed before runs in as many tasks."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def gathered(df: DataFrame) -> DataFrame:
    """The same by a shuffle of the rows, so that the work before it keeps its tasks."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))


def dropped(*tables: DataFrame | None) -> None:
    """Delete materialised tables, after their last reader has run."""
    for t in tables:
        if (path := getattr(t, "_geolith_path", None)) is not None:
            _remove(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has ended; the folder belongs to it
        return
