"""A session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "termforge", **conf: str) -> SparkSession:
    """UTC timestamps, adaptive execution with skew splitting; everything else is the cluster's."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
