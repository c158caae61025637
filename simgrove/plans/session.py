"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow; the cluster's own settings win where they are given."""
    b = SparkSession.builder.appName("simgrove")
    if master:
        b = b.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
