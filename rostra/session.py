"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "rostra", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC days, adaptive plans and dynamic partition overwrite; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
