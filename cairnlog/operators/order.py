"""Ranks and running sums over a whole table in key order, without one task
that holds it: bounds from a bounded sample of keys cut the keys into ranges,
totals of the ranges give each its base, and windows run within a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are sampled for bounds for each range, and the ranges where the rows haven't been counted.
SAMPLED, RANGES = 64, 64


def bounds(rows: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Up to ranges - 1 keys that cut the rows into similar parts: exact order
    statistics of the sample with the smallest hashes."""
    if ranges == 1:
        return []
    few = rows.select(key, F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLED * ranges).collect()
    keys = sorted({bytes(r[0]) if isinstance(r[0], (bytes, bytearray)) else r[0] for r in few})
    step = max(1, len(keys) // ranges)
    return keys[step::step]


def running(rows: DataFrame, key: str, value: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds rank (from 1, by key, which must be unique) and, for a value, its
    sum before the row. Who knows the number of rows sets the ranges by it."""
    cuts = bounds(rows, key, ranges)
    # The number of bounds at or below the key, from the sorted literal array.
    listed = F.array(*map(F.lit, cuts)) if cuts else None
    part = F.size(F.filter(listed, lambda b: b <= F.col(key))) if cuts else F.lit(0)
    rows = rows.withColumn("range_", part).withColumn("value_", F.col(value).cast("long") if value else F.lit(0).cast("long"))
    totals = rows.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"), F.sum("value_").alias("s_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = totals.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n_"), F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("s_"))
    within = Window.partitionBy("range_").orderBy(key)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, "range_").withColumn("rank", (F.col("n_") + F.row_number().over(within)).cast("long"))
    out = out.withColumn("before", (F.col("s_") + F.coalesce(F.sum("value_").over(earlier), F.lit(0))).cast("long"))
    return out.drop("range_", "value_", "n_", "s_")
