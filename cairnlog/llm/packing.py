"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into as many pieces of the longest
length as fit and then into the binary digits of the rest, longest first. A
piece is a sequence by itself: its length is a power of two, so it needs no
padding, no sequence crosses documents, and batches are formed from the bucket
of one length. Sequence numbers come from the task's number and a counter, so
nothing is shuffled or ranked globally and a task that runs again gives the
same rows.

Null or empty text: the end id alone, one piece of length 1. Null and repeated
ids: each row is packed by itself. Very long texts: pieces leave the task as
they are cut. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import batches, documents, id_and_text, release, stream

LONGEST = 1024
END = 0

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("tokens", pa.binary()),
    ]
)
PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, tokens binary"


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, descending, that sum to n; none exceeds the longest."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, longest: int = LONGEST, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, tokens (little-endian
    unsigned 32-bit ids); within what a task hands on at once, pieces of equal
    length stand together."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary).ids
        last = int(end).to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 33

        def pieces() -> Iterator[tuple]:
            for held in bpe.together(stream(it, "doc_id", "text")):
                yield from cut(held)

        def cut(held: list[tuple]) -> Iterator[tuple]:
            nonlocal number
            for (doc_id, _), ids in zip(held, encode([t for _, t in held])):
                ids += last
                total, at = len(ids) // 4, 0
                for n in lengths(total, longest):
                    yield doc_id, at, n, total, number, ids[4 * at : 4 * (at + n)]
                    at, number = at + n, number + 1

        for batch in batches(pieces(), PIECES, lambda r: 64 + len(r[5])):
            yield batch.take(pa.compute.sort_indices(batch.column(2)))
        release()

    return id_and_text(docs).mapInArrow(run, PIECES_DDL)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length; rows of a folder stack to a rectangular batch."""
    pieces.write.partitionBy("length").parquet(path)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), bpe.vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens",
        "sequence_id", F.lit(0).cast("long").alias("offset"),
    )
