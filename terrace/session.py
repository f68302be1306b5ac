"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "terrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` only where the launcher sets none."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
