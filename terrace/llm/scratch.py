"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Arrays of four megabytes or more go back to the system as soon as a worker is done with them; otherwise workers, which
#: are used again, grow by what their tasks leave behind.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, lets Python workers import this package and give memory back.

    Only settings that the session leaves at their defaults are touched. On a
    cluster whose workers do not see the driver's folder, ship the package
    with ``--py-files``.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception as e:  # an older Spark: the record bound above still holds
        if "maxBytesPerBatch" not in str(e):
            raise
    env = spark.sparkContext.environment
    for name, value in WORKERS.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *paths])


def root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and there is no cluster."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrace-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/scratch-{sc.applicationId}"


#: Folders that this process has asked for and not dropped.
made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    made.append(f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return made[-1]


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Asks the driver to let go of shuffle files that no plan needs any more."""
    import gc
    import time

    for _ in range(2):  # what the first round finds is freed behind the scenes
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables. Only for tables whose readers have all been written."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in made:
            made.remove(path)
