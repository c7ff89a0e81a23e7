"""The key/value projection of a log: the last record of a key wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LogError
from .order import running

#: Offsets stay below this, so that one LONG orders the log.
OFFSETS = 1 << 36


def place() -> Column:
    """The physical order as one number: it aggregates by hash, a struct would by sort."""
    segment, offset = F.col("segment"), F.col("offset")
    return segment * F.lit(OFFSETS) + F.when(offset < OFFSETS, offset).otherwise(F.raise_error(F.lit("offset too large")))


def keydir(log: DataFrame) -> DataFrame:
    """key, segment, offset, len, txid of each live key: the last record is a
    put. Only places, sizes and numbers move, all of fixed width, so that both
    steps of the aggregate are by hash."""
    put = F.when(F.col("record_type") == "Put", place())
    touched = log.where("record_type <> 'Raw'").select("key", place().alias("at"), put.alias("put_at"), "len", "txid")
    last = touched.groupBy("key").agg(
        F.max("at").alias("at"), F.max("put_at").alias("put_at"), F.max_by("len", "at").alias("len"), F.max_by("txid", "at").alias("txid")
    )
    live = last.where("at = put_at")
    return live.select("key", F.shiftright("at", 36).alias("segment"), F.col("at").bitwiseAND(F.lit(OFFSETS - 1)).alias("offset"), "len", "txid")


def items(log: DataFrame) -> DataFrame:
    """key and value of each live key. The value rides in the aggregate, so a
    key's older values go before the shuffle."""
    touched = log.where("record_type <> 'Raw'").select("key", place().alias("at"), "record_type", "payload")
    last = touched.groupBy("key").agg(F.max_by("record_type", "at").alias("record_type"), F.max_by("payload", "at").alias("value"))
    return last.where("record_type = 'Put'").select("key", "value")


def items_by_reference(log: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """The same for large payloads: find the places first (in heads, the same
    log read without payloads, where there is one), then fetch them."""
    refs = keydir(log if heads is None else heads).select("key", "segment", "offset")
    return refs.join(log.select("segment", "offset", F.col("payload").alias("value")), ["segment", "offset"]).select("key", "value")


def keys(log: DataFrame) -> DataFrame:
    return keydir(log).select("key")


def count(log: DataFrame) -> DataFrame:
    return keydir(log).agg(F.count(F.lit(1)).alias("live_keys"), (F.count(F.lit(1)) == 0).alias("is_empty"))


def get(log: DataFrame, key: bytes) -> DataFrame:
    """The value of one key; the filter stands below the aggregate."""
    return items(log.where(F.col("key") == F.lit(key)))


def ref_of(log: DataFrame, key: bytes) -> DataFrame:
    return keydir(log.where(F.col("key") == F.lit(key))).select("segment", "offset", "len")


def contains(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and whether it is live, for each wanted key."""
    live = keys(log).withColumn("live", F.lit(True))
    return wanted.select("key").distinct().join(live, "key", "left").select("key", F.coalesce("live", F.lit(False)).alias("live"))


def history(log: DataFrame, key: bytes) -> DataFrame:
    return log.where((F.col("key") == F.lit(key)) & (F.col("record_type") != "Raw")).orderBy("segment", "offset")


def compact(log: DataFrame) -> DataFrame:
    """The frames of a compacted store, one segment, in key order from number 1."""
    from ..functions.wire import wire_size

    live = items(log).withColumn("len", wire_size(F.col("key"), F.col("value")))
    return running(live, "key", "len").select(
        F.lit(1).cast("long").alias("segment"), F.col("before").alias("offset"), "len", F.lit("Put").alias("record_type"),
        F.col("rank").alias("txid"), "key", F.col("value").alias("payload"),
    )


def compaction_stats(log: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return keydir(log).agg(n.alias("live_keys"), n.alias("records_written"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("bytes_written"))


def check(log: DataFrame, report: DataFrame) -> DataFrame:
    """Live keys beside the counters of a report; both have one row."""
    counted = keydir(log).agg(F.count(F.lit(1)).alias("keys_checked"))
    one = F.lit(1)
    return counted.withColumn("one", one).join(report.withColumn("one", one), "one").select(
        "keys_checked", "tail_truncated", "tail_bytes_discarded", "mid_stream_errors", "unsupported_versions"
    )


def export_lines(log: DataFrame) -> DataFrame:
    """key and its line of JSON."""
    from ..functions.encoding import base64_of

    line = F.to_json(F.struct(base64_of(F.col("key")).alias("key_b64"), base64_of(F.col("value")).alias("value_b64")))
    return items(log).select("key", line.alias("line"))


def export_stats(log: DataFrame) -> DataFrame:
    lines = export_lines(log)
    return lines.agg(F.count(F.lit(1)).alias("records_written"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).cast("long").alias("bytes_written"))


def latest_wins(ops: DataFrame, key: str, order: str, kept: Iterable[str]) -> DataFrame:
    """The last row of each key, by window: for several kept columns at once."""
    if order in kept or key in kept:
        raise LogError("key and order are kept anyway")
    by = Window.partitionBy(key).orderBy(F.col(order).desc())
    return ops.withColumn("nth_", F.row_number().over(by)).where("nth_ = 1").select(key, order, *kept)
