"""Session defaults for batch work on bar panels."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "barloom", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC timestamps and adaptive execution."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
