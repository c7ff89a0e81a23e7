"""The last-write-wins view of a growing log.

Order is physical, not time, so there is no watermark: each micro-batch's
frames are folded to one row a key and merged into the view, whose newest
place wins. Batches that come again change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kv import place
from ..sources.datasource import register

VIEW = "key binary, at long, record_type string, value binary"


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """A store as an unbounded DataFrame; each batch is a reopening."""
    register(spark)
    return spark.readStream.format("framedlog").option("path", path).load()


def fold_batch(frames: DataFrame) -> DataFrame:
    """key, at, record_type, value: the last record of each key in a batch, tombstones too."""
    touched = frames.where("record_type <> 'Raw'").select("key", place().alias("at"), "record_type", "payload")
    return touched.groupBy("key").agg(
        F.max("at").alias("at"), F.max_by("record_type", "at").alias("record_type"), F.max_by("payload", "at").alias("value")
    ).select("key", "at", "record_type", "value")


def merge(view: DataFrame, batch: DataFrame) -> DataFrame:
    """Two folds as one: per key the later place."""
    both = view.unionByName(batch)
    return both.groupBy("key").agg(
        F.max("at").alias("at"), F.max_by("record_type", "at").alias("record_type"), F.max_by("value", "at").alias("value")
    )


def live(view: DataFrame) -> DataFrame:
    return view.where("record_type = 'Put'").select("key", "value")


class ViewWriter:
    """For foreachBatch: keeps the view as numbered folders below a path. A
    batch writes the folder of its number from that of the one before, so a
    batch that is tried again writes the same."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def folder(self, number: int) -> str:
        return f"{self.path}/view-{number:08d}"

    def current(self, spark: SparkSession, number: int) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], VIEW)
        return spark.read.schema(VIEW).parquet(self.folder(number))

    def __call__(self, frames: DataFrame, number: int) -> None:
        spark = frames.sparkSession
        merge(self.current(spark, number - 1), fold_batch(frames)).write.mode("overwrite").parquet(self.folder(number))


def live_changes(frames: DataFrame) -> DataFrame:
    """The same as a stateful operator: a row for each key that a batch
    touches, its state after the batch. State is one row a key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, kind, value = state.get if state.exists else (-1, "", b"")
        for b in batches:
            i = b["at"].idxmax()
            if b["at"][i] > at:
                at, kind, value = int(b["at"][i]), b["record_type"][i], b["payload"][i]
        state.update((at, kind, bytes(value)))
        yield pd.DataFrame({"key": [key[0]], "at": [at], "record_type": [kind], "value": [bytes(value)]})

    touched = frames.where("record_type <> 'Raw'").select("key", place().alias("at"), "record_type", "payload")
    return touched.groupBy("key").applyInPandasWithState(
        update, VIEW, "at long, record_type string, value binary", "update", GroupStateTimeout.NoTimeout
    )
