"""A log over the shared test table `events`: 1000 operations to a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encoding import utf8
from ..functions.wire import wire_size

PER_SEGMENT = 1000


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment, pos, txid, record_type, key, payload: errors delete, views are raw, the rest puts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "props")
    kind = F.when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "view", "Raw").otherwise("Put")
    none = F.lit(b"")
    return e.select(
        (F.floor(F.col("event_id") / PER_SEGMENT) + 1).cast("long").alias("segment"), F.col("event_id").alias("pos"),
        (F.col("event_id") + 1).alias("txid"), kind.alias("record_type"),
        F.when(kind == "Raw", none).otherwise(utf8(F.col("user_id").cast("string"))).alias("key"),
        F.when(kind == "Delete", none).otherwise(utf8(F.col("props"))).alias("payload"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = Window.partitionBy("segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = operations(spark, sf_dir).withColumn("len", wire_size(F.col("key"), F.col("payload")))
    return sized.select(
        "segment", F.coalesce(F.sum("len").over(earlier), F.lit(0)).alias("offset"), "len", "record_type", "txid", "key", "payload"
    )


LOG_SQL = f"""
WITH ops AS (
  SELECT event_id // {PER_SEGMENT} + 1 AS segment, event_id AS pos, event_id + 1 AS txid,
         CASE event_type WHEN 'error' THEN 'Delete' WHEN 'view' THEN 'Raw' ELSE 'Put' END AS record_type,
         CASE event_type WHEN 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END AS key,
         CASE event_type WHEN 'error' THEN '' ELSE props END AS payload
  FROM events
), sized AS (
  SELECT *, CAST(28 + octet_length(encode(key)) + octet_length(encode(payload)) AS BIGINT) AS len FROM ops
), L AS (
  SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS BIGINT) AS off
  FROM sized
), K AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txid DESC) AS nth FROM L WHERE record_type <> 'Raw')
  WHERE nth = 1 AND record_type = 'Put'
)"""
