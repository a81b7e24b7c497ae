"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The UTC zone makes dates a function of the epoch alone; adaptive execution re-plans joins, skew and partition counts at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "threadloom", **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; keyword settings have underscores for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
