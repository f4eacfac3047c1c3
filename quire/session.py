"""A session with the settings the library is tuned for; any other session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quire", **conf: str) -> SparkSession:
    """An adaptive, UTC session; `conf` adds to or replaces the defaults (dots as double underscores)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
