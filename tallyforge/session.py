"""Sessions with the settings that the engine's answers rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and ANSI fix the answers; AQE re-plans joins and partition counts by measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timeType.enabled": "true",
}


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; ``settings`` has further keys, with ``__`` for dots."""
    builder = SparkSession.builder.appName("tallyforge")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
