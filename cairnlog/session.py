"""A session with the settings the engine expects; all can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cairnlog", **settings: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
