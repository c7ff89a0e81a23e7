"""What the training-data operators share: the shared folder, safe columns
and streaming of Arrow batches through plain Python."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Python output that a task gathers before it hands a batch on.
FLUSH_BYTES = 8 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, which every executor
    sees. Only where that is unset (tests, one machine) a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairnlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost
    executor costs no more than the tasks it was running."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow's file system for a URI of the shared folder, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def canonical() -> tuple[Column, Column]:
    """Id and text as all operators take them; null text is empty."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def id_and_text(docs: DataFrame, *more: str | Column) -> DataFrame:
    """Only the columns an operator needs, so others can't clash."""
    return docs.select(*canonical(), *more)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of the input has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5))


def batches(
    rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda r: 64
) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= FLUSH_BYTES:
            yield to_batch(held, schema)
            held, total = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema
    )


def release() -> None:
    """Give back what earlier tasks of this worker have freed: allocators keep it otherwise."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def stream(batches_in: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of the named columns, a slice at a time
    so that only few long texts are Python objects at once."""
    release()
    for b in batches_in:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))
