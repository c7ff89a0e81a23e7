"""Scans, reports and references over a log DataFrame (LOG_SCHEMA, any integer txid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import base64_of
from ..model import CRC_MISMATCH, OK, TRUNCATED, LogError

ORDER = ("segment", "offset")


def segments(log: DataFrame) -> DataFrame:
    return log.select("segment").distinct()


def active_segment(log: DataFrame) -> DataFrame:
    return log.agg(F.max("segment").alias("segment"))


def next_segment(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("segment"), F.lit(0)) + 1).alias("segment"))


def segment_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy("segment").agg(F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("records"))


def from_cursor(log: DataFrame, segment: int, offset: int = 0) -> DataFrame:
    """At or after a place; give the source from_segment too, and it reads no earlier file."""
    return log.where((F.col("segment") >= segment) & ((F.col("segment") > segment) | (F.col("offset") >= offset)))


def snapshot(log: DataFrame, last_segment: int) -> DataFrame:
    """What a reader sees that was opened when this was the last segment."""
    return log.where(F.col("segment") <= last_segment)


def in_order(log: DataFrame, limit: int | None = None) -> DataFrame:
    out = log.orderBy(*ORDER)
    return out if limit is None else out.limit(limit)


def of_type(log: DataFrame, record_type: str) -> DataFrame:
    return log.where(F.col("record_type") == record_type)


def references(log: DataFrame) -> DataFrame:
    return log.select("segment", "offset", "len")


def assign_references(ops: DataFrame, first_txid: int = 1) -> DataFrame:
    """From operations (segment, pos, record_type, key, payload): the offset of
    each frame, a running sum within its segment, and its number. Numbers run
    on from the operations of earlier segments, counted per segment first."""
    from ..functions.wire import wire_size

    counts = ops.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each segment.
    base = counts.select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("segment").orderBy("pos")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    sized = ops.withColumn("len", wire_size(F.col("key"), F.col("payload"))).join(base, "segment")
    return sized.withColumn("offset", F.coalesce(F.sum("len").over(earlier), F.lit(0))).withColumn(
        "txid", F.col("base") + F.row_number().over(within) - 1 + first_txid
    ).drop("base")


def dereference(refs: DataFrame, log: DataFrame) -> DataFrame:
    """The frames that references point to."""
    return refs.select("segment", "offset").join(log, ["segment", "offset"])


def as_json(log: DataFrame, schema: str) -> Column:
    return F.to_json(
        F.struct(
            F.lit(schema).alias("schema"), F.lit("record").alias("kind"), "segment", "offset", "len", "record_type", "txid",
            base64_of(F.col("key")).alias("key_base64"), base64_of(F.col("payload")).alias("payload_base64"),
        )
    )


def headers(log: DataFrame) -> DataFrame:
    return log.select(
        "segment", "offset", "len", "record_type", "txid", F.octet_length("key").alias("key_len"), F.octet_length("payload").alias("payload_len")
    )


def check_frames(frames: DataFrame, last_segment: int | None) -> None:
    """Raise on damage that recovery must not pass over: anything but a torn
    tail of the last segment. At most one row of each segment can say so."""
    torn = F.col("status").isin(TRUNCATED, CRC_MISMATCH) & (F.col("segment") == F.lit(last_segment))
    bad = frames.where((F.col("status") != OK) & ~torn).orderBy(*ORDER).limit(1).collect()
    if bad:
        raise LogError(f"{bad[0].status} at offset {bad[0].offset} of segment {bad[0].segment}")


def recovery_report(frames: DataFrame, files_scanned: int | None = None) -> DataFrame:
    """From frames with a status: the seven counters of an open. The number of
    files comes from the listing, since an empty segment has no frame."""
    good = F.col("status") == OK
    files = F.count_distinct("segment") if files_scanned is None else F.lit(files_scanned).cast("long")
    return frames.agg(
        files.alias("files_scanned"), F.count_if(good).alias("records_replayed"), F.count_if(~good).alias("tail_truncated"),
        F.coalesce(F.sum(F.when(~good, F.col("available"))), F.lit(0)).cast("long").alias("tail_bytes_discarded"),
        F.lit(0).cast("long").alias("mid_stream_errors"), F.lit(0).cast("long").alias("unsupported_versions"),
        F.coalesce(F.max(F.when(good, F.col("txid"))), F.lit(0)).alias("last_txid_seen"),
    )


def verify(frames: DataFrame) -> DataFrame:
    good = F.col("status") == OK
    last = F.max(F.when(good, F.struct("segment", "offset")))
    return frames.agg(
        F.count_if(good).alias("frames_checked"), F.lit(0).cast("long").alias("crc_failures"), F.count_if(~good).alias("tail_truncated"),
        F.coalesce(F.sum(F.when(~good, F.col("available"))), F.lit(0)).cast("long").alias("tail_bytes_discarded"),
        F.coalesce(last["segment"], F.lit(0)).alias("last_segment"), F.coalesce(last["offset"], F.lit(0)).alias("last_offset"),
    )


def with_status(log: DataFrame) -> DataFrame:
    """A clean log as frames."""
    none = F.lit(None).cast("long")
    return log.withColumns({"status": F.lit(OK), "available": none, "needed": none})


def gaps(log: DataFrame) -> DataFrame:
    """Segment numbers that are missing below the highest one. A row for each segment."""
    here = segments(log)
    nxt = F.lead("segment").over(Window.orderBy("segment"))
    return here.withColumn("next", nxt).where("next > segment + 1").select(F.explode(F.expr("sequence(segment + 1, next - 1)")).alias("segment"))
