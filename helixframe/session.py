"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "helixframe", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI, UTC, adaptive execution with skew joins; anything else by keyword (dots as __)."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
