"""Stores and exports made from a log as Spark jobs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..model import SUFFIX, LogError
from .kv import keydir
from .order import running

#: Keys of a range that is ranked in one task.
RANGE_KEYS = 1 << 20


def append(rows: DataFrame, path: str) -> None:
    """Rows (record_type, key, payload) as new segments, one for each
    partition. Partitions are counted first, so that each task knows the number
    its frames begin with; between the two the rows are kept (memory, then disk)."""
    from ..sources.datasource import register

    register(rows.sparkSession)
    rows = rows.select("record_type", "key", "payload").persist()
    try:
        counts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
        bases, before = {}, 0
        for r in sorted(counts):
            bases[r.part] = (before, r.n)
            before += r.n
        _write(rows.write.format("framedlog").option("bases", json.dumps(bases)), path)
    finally:
        rows.unpersist()


def append_numbered(rows: DataFrame, path: str) -> None:
    """The same for rows with their numbers (txid from 1, ascending over
    partitions). With a column segment, ascending too, a partition writes as many as it tells."""
    from ..sources.datasource import register

    register(rows.sparkSession)
    _write(rows.select("txid", "record_type", "key", "payload", *{"segment"}.intersection(rows.columns)).write.format("framedlog"), path)


def _write(writer: DataFrameWriter, path: str) -> None:
    writer.option("path", path).mode("append").save()


def compact_to(log: DataFrame, path: str, segments: int = 1, heads: DataFrame | None = None) -> None:
    """A new store with one put for each live key, in key order from number 1.
    One segment by default; more are written in parallel, by ranges of keys.
    heads: the same log read without payloads, which places don't need."""
    from ..sources.fs import filesystem

    files, base = filesystem(path)
    info = files.get_file_info(base)
    if info.type.name == "Directory":
        from pyarrow import fs

        if files.get_file_info(fs.FileSelector(base)):
            raise LogError(f"target is not empty: {path}")
    elif info.type.name != "NotFound":
        raise LogError(f"not a directory: {path}")
    files.create_dir(base, recursive=True)
    # Keys are ranked by their references; payloads move once, to the segment that takes them.
    refs = keydir(log if heads is None else heads).select("key", "segment", "offset").persist()
    try:
        n = refs.count()
        ranked = running(refs, "key", ranges=max(1, -(-n // RANGE_KEYS))).select("segment", "offset", F.col("rank").alias("number"))
        live = log.select("segment", "offset", "key", "payload").join(ranked, ["segment", "offset"])
        live = live.withColumn("part", F.floor((F.col("number") - 1) * segments / max(1, n)).cast("int"))
        dealt = live.repartitionById(segments, "part").sortWithinPartitions("number")
        append_numbered(dealt.select(F.col("number").alias("txid"), F.lit("Put").alias("record_type"), "key", "payload"), path)
    finally:
        refs.unpersist()
    if os.path.isdir(base) and not any(n.endswith(SUFFIX) for n in os.listdir(base)):
        from ..sources.store import RecordLog

        RecordLog(path).close()  # an empty log is a store with one empty segment


def gap_report(log: DataFrame) -> DataFrame:
    """Numbers of missing segments, as one row."""
    from .log import gaps

    return gaps(log).agg(F.count(F.lit(1)).alias("missing"), F.min("segment").alias("first_missing"))
