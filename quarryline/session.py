"""The session settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarryline", **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution; ``conf`` adds to that (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
