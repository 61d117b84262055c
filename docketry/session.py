"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "docketry", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; ``settings`` are further options with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call sites of every expression cost more than building most plans
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in (conf | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
