"""Lines of JSON with base64 fields, parsed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(lines: DataFrame) -> DataFrame:
    """From `value` lines {"key","payload"}: both as bytes; blank lines are passed over."""
    row = F.from_json(F.col("value"), "key string, payload string")
    return lines.where(F.trim("value") != "").select(row.alias("r")).select(
        F.unbase64("r.key").alias("key"), F.unbase64("r.payload").alias("payload")
    )
