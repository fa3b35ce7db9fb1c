"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def engine_session(app: str = "quillmill", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive execution with skew handling, Arrow; sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
