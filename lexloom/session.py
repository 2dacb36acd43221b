"""A session with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE splits skewed joins and coalesces small partitions; UTC keeps timestamps comparable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "lexloom", **extra: str) -> SparkSession:
    """The active session, or a new one with SETTINGS; `extra` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
