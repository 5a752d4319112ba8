"""SparkSession factory: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "graphloom", **settings: str) -> SparkSession:
    """A session with this library's settings; others are given as name=value with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
