"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, and whatever else is given (dots as double underscores)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    }
    builder = SparkSession.builder.appName(app).config(map=settings | {k.replace("__", "."): str(v) for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
