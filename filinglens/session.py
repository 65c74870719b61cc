"""Session defaults; everything else is left to the cluster's own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "filinglens", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, which sizes shuffle partitions and splits skewed joins at run time."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
