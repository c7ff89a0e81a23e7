"""Queries over a store that is written as files first: events as segments,
with a torn tail, and with a damaged frame in a sealed segment. The SQL says
what must be left of the rows that were written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HEADER_BYTES
from ..operators import derive, kv, log
from ..sources import fs
from ..sources.codec import encode_frame
from ..sources.datasource import read_log
from .eventlog import PER_SEGMENT, operations
from .reference_queries import query

#: Segments that one task writes: a share of all within two bounds.
SHARES, LEAST, MOST = 64, 8, 256
#: Bytes of a frame that a crash left behind, and the place in segment 1 of the frame that is damaged.
TORN, DAMAGED = 11, 400


def _folder(spark: SparkSession) -> str:
    """A fresh name where the driver and all executors write (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cairnlog-")
    if "://" not in root and not root.startswith("file:"):
        root = os.path.abspath(root)
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def _edit(path: str, segment: int, change) -> None:
    """Write one segment's file anew."""
    files, base = fs.filesystem(path)
    name = f"{base}/{fs.segment_name(segment)}"
    with files.open_input_file(name) as f:
        data = f.read()
    with files.open_output_stream(name) as out:
        out.write(change(data))


def _store(spark: SparkSession, sf_dir: str, torn: bool = True) -> str:
    path = _folder(spark)
    rows = operations(spark, sf_dir)
    last = rows.agg(F.max("segment")).first()[0] or 1
    files, base = fs.filesystem(path)
    files.create_dir(base, recursive=True)
    each = min(MOST, max(LEAST, -(-last // SHARES)))
    dealt = rows.repartitionById(-(-last // each), F.floor((F.col("segment") - 1) / each).cast("int")).sortWithinPartitions("txid")
    derive.append_numbered(dealt, path)
    if torn:
        _edit(path, last, lambda data: data + encode_frame("Put", 1, b"key", b"payload")[:TORN])
    return path


_TAIL = f"1 AS tail_truncated, {TORN} AS tail_bytes_discarded"


@query("binary_scan", 'SELECT segment, off AS "offset", len, record_type, txid, hex(encode(key)) AS key, hex(encode(payload)) AS payload FROM L')
def binary_scan(spark: SparkSession, d: str) -> DataFrame:
    e = read_log(spark, _store(spark, d))
    return e.select("segment", "offset", "len", "record_type", F.col("txid").cast("long").alias("txid"), F.hex("key").alias("key"), F.hex("payload").alias("payload"))


@query("binary_items", "SELECT hex(encode(key)) AS key, hex(encode(payload)) AS value FROM K")
def binary_items(spark: SparkSession, d: str) -> DataFrame:
    path = _store(spark, d)
    return kv.items_by_reference(read_log(spark, path, mode="lazy"), read_log(spark, path, mode="lazy", payload="false")).select(F.hex("key").alias("key"), F.hex("value").alias("value"))


def _frames(spark: SparkSession, path: str) -> DataFrame:
    """What the reports look at; checksums cover the payloads all the same."""
    return read_log(spark, path, mode="frames", payload="false")


@query(
    "binary_report",
    f"SELECT count(DISTINCT segment) AS files_scanned, count(*) AS records_replayed, {_TAIL}, 0 AS mid_stream_errors, 0 AS unsupported_versions, max(txid) AS last_txid_seen FROM L",
)
def binary_report(spark: SparkSession, d: str) -> DataFrame:
    path = _store(spark, d)
    return log.recovery_report(_frames(spark, path), len(fs.list_segments(path))).withColumn("last_txid_seen", F.col("last_txid_seen").cast("long"))


@query(
    "binary_verify",
    f"""SELECT count(*) AS frames_checked, 0 AS crc_failures, {_TAIL}, max(segment) AS last_segment,
       arg_max(off, txid) AS last_offset FROM L""",
)
def binary_verify(spark: SparkSession, d: str) -> DataFrame:
    return log.verify(_frames(spark, _store(spark, d)))


@query("binary_check", f"SELECT count(*) AS keys_checked, {_TAIL}, 0 AS mid_stream_errors, 0 AS unsupported_versions FROM K")
def binary_check(spark: SparkSession, d: str) -> DataFrame:
    path = _store(spark, d)
    return kv.check(read_log(spark, path, payload="false"), log.recovery_report(_frames(spark, path)))


@query(
    "binary_damage",
    f"""SELECT segment, count(*) FILTER (NOT (segment = 1 AND pos >= {DAMAGED})) AS good,
       CASE WHEN segment = 1 THEN 'crc_mismatch' ELSE 'none' END AS status,
       CASE WHEN segment = 1 THEN min(off) FILTER (pos >= {DAMAGED}) ELSE -1 END AS bad_offset,
       CAST(CASE WHEN segment = 1 THEN sum(len) FILTER (pos >= {DAMAGED}) ELSE 0 END AS BIGINT) AS lost_bytes
FROM L GROUP BY segment""",
)
def binary_damage(spark: SparkSession, d: str) -> DataFrame:
    """A flipped byte in segment 1: what stands before it is read, in frames mode its row says what and where."""
    path = _store(spark, d, torn=False)
    first = operations(spark, d).where(F.col("segment") == 1).orderBy("pos").limit(DAMAGED)
    from ..functions.wire import wire_size

    at = first.agg(F.coalesce(F.sum(wire_size(F.col("key"), F.col("payload"))), F.lit(0))).first()[0] + HEADER_BYTES - 9
    _edit(path, 1, lambda data: data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    good = F.col("status") == "ok"
    return _frames(spark, path).groupBy("segment").agg(
        F.count_if(good).alias("good"), F.coalesce(F.max(F.when(~good, F.col("status"))), F.lit("none")).alias("status"),
        F.coalesce(F.max(F.when(~good, F.col("offset"))), F.lit(-1)).alias("bad_offset"),
        F.coalesce(F.max(F.when(~good, F.col("available"))), F.lit(0)).alias("lost_bytes"),
    )


@query("binary_compact", 'SELECT hex(encode(key)) AS key, row_number() OVER (ORDER BY encode(key)) AS txid, CAST(28 + octet_length(encode(key)) + octet_length(encode(payload)) AS BIGINT) AS len FROM K')
def binary_compact(spark: SparkSession, d: str) -> DataFrame:
    """Compacted to a new store of four segments and read back."""
    target = _folder(spark)
    path = _store(spark, d)
    derive.compact_to(read_log(spark, path), target, segments=4, heads=read_log(spark, path, mode="lazy", payload="false"))
    return read_log(spark, target).select(F.hex("key").alias("key"), F.col("txid").cast("long").alias("txid"), "len")
