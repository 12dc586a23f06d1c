"""A Spark session with the settings that the library is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "readgrain", **settings: str) -> SparkSession:
    """Adaptive execution (run-time joins, skew and partition sizes), Arrow and UTC; `settings` override, with _ for dots."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    conf |= {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
