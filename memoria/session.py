"""The session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "memoria", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. ANSI mode stays on: operators never rely on silent overflow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    } | conf
    return builder.config(map=settings).getOrCreate()
