"""Session builder with the settings this engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "fathom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is left to the cluster or to conf (dots written as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true"}
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
