"""A session with the settings the retail jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "millrace", **settings: str) -> SparkSession:
    """Local time zone of the shops, ANSI mode and adaptive execution; settings come on top."""
    conf = {
        "spark.sql.session.timeZone": "Asia/Bangkok",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=conf | settings).getOrCreate()
