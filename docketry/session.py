"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "docketry", **conf: str) -> SparkSession:
    """A session for ``name``; ``conf`` takes keys with ``__`` for dots, and wins over :data:`CONF`."""
    builder = SparkSession.builder.appName(name)
    for key, value in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
