"""A session with the settings that the engine's plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow. On a cluster the master and the number of partitions come from its own settings."""
    builder = SparkSession.builder.appName("recollect")
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in own.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
