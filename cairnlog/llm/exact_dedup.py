"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every partition sorts the 64-bit fingerprints of its normalised texts (A-Z
   lower-cased, nothing else), and sends each owner of a range of fingerprints
   one Golomb-coded list (the power-of-two parameter that suits its mean gap).
2. An owner decodes its lists and answers each with a bitmap: which entries
   another partition, or another row of the same one, has too.
3. Every partition reads its bitmaps, marks its suspects and hands on their
   texts; all other rows are unique and their texts move nowhere.
4. Suspects meet by fingerprint and are compared byte for byte.

The lists and bitmaps lie in the shared folder by partition number. The second
pass must see the partitions of the first: each list carries the partition's
row count and the exclusive or of its fingerprints, and a difference raises.

Null and empty texts are equal. Of equal texts the row with the largest doc_id
stays (null is smallest); among rows of one id that are equal too, the last
one read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golomb
from .common import batches, documents, id_and_text, materialise, stream
from .parts import print_of, read_part, row_id, steady, write_by_part

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
#: Rows an owner is meant to hold, and the least number of owners.
OWNER_ROWS, LEAST_OWNERS = 1 << 22, 64


def normalise(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z alone


def fingerprint(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


SENT = pa.schema(
    [
        ("part", pa.int64()), ("owner", pa.int64()), ("rows", pa.int64()), ("mixed", pa.int64()),
        ("own", pa.binary()), ("list", pa.binary()),
    ]
)
SENT_DDL = "part long, owner long, rows long, mixed long, own binary, list binary"
MARKED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("text_sha256", pa.string()),
        ("finger", pa.int64()), ("suspect", pa.binary()),
    ]
)
MARKED_DDL = "row long, doc_id long, print long, text_sha256 string, finger long, suspect binary"


def _send(docs: DataFrame, owners: int) -> DataFrame:
    """A row for each partition and owner: Golomb list of the fingerprints and
    a bitmap of those that the partition itself has twice."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        prints = np.fromiter((fingerprint(normalise(t)) for (t,) in stream(it, "text")), np.uint64)
        if not len(prints):
            return
        mixed = int(np.bitwise_xor.reduce(prints).astype(np.int64))
        values, counts = np.unique(prints, return_counts=True)
        cut = [*np.searchsorted(values, golomb.starts(owners)).tolist(), len(values)]
        base = golomb.starts(owners)

        def rows() -> Iterator[tuple]:
            for k in range(owners):
                a, b = cut[k], cut[k + 1]
                if a < b:
                    own = np.packbits(counts[a:b] > 1).tobytes()
                    yield part, k, len(prints), mixed, own, golomb.encode(values[a:b] - base[k])

        yield from batches(rows(), SENT, lambda r: 64 + len(r[5]))

    return docs.mapInArrow(run, SENT_DDL)


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps, one for each list."""
    lists = [golomb.decode(x) for x in frame["list"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    double = values[counts > 1]
    maps = []
    for x, own in zip(lists, frame["own"]):
        has = np.isin(x, double, assume_unique=True) if len(double) else np.zeros(len(x), bool)
        maps.append(np.packbits(has | np.unpackbits(np.frombuffer(own, np.uint8), count=len(x)).astype(bool)).tobytes())
    return pd.DataFrame({"part": frame["part"], "owner": frame["owner"], "bitmap": maps})


def _mark(docs: DataFrame, sent: str, answers: str, owners: int) -> DataFrame:
    """Each row with its hash; the normalised bytes too where a bitmap says so."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def read(uri: str, columns: list[str]) -> dict:
            return {r["owner"]: r for r in read_part(uri, part, columns)}

        own, base = None, golomb.starts(owners)
        double: set[int] = set()
        seen = mixed = 0

        def rows() -> Iterator[tuple]:
            nonlocal own, seen, mixed
            for doc_id, text, seen_as in stream(it, "doc_id", "text", "print"):
                if own is None:
                    own = read(sent, ["part", "owner", "rows", "mixed", "list"])
                    maps = read(answers, ["part", "owner", "bitmap"])
                    for k, r in own.items():
                        values = golomb.decode(r["list"]) + base[k]
                        bits = np.unpackbits(np.frombuffer(maps[k]["bitmap"], np.uint8), count=len(values))
                        double.update(values[bits == 1].tolist())
                data = normalise(text)
                p = fingerprint(data)
                signed = p - (1 << 64) if p >> 63 else p
                yield row_id(part, seen), doc_id, seen_as, hashlib.sha256(data).hexdigest(), signed, data if p in double else None
                seen, mixed = seen + 1, mixed ^ p
            if own is not None:
                first = next(iter(own.values()), {"rows": 0, "mixed": 0})
                if (first["rows"], first["mixed"] % (1 << 64)) != (seen, mixed):
                    raise ValueError("the input's partitions changed between the two passes")

        yield from batches(rows(), MARKED, lambda r: 200 + len(r[5] or b""))

    return docs.mapInArrow(run, MARKED_DDL)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """row (a number for the input row), doc_id, print (of the input row), keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    steady(spark)
    docs = id_and_text(docs, print_of().alias("print"))
    owners = max(LEAST_OWNERS, -(-docs.count() // OWNER_ROWS))
    sent = write_by_part(_send(docs, owners), "sent", gather=False)
    replies = spark.read.schema(SENT_DDL).parquet(sent).select("part", "owner", "own", "list").groupBy("owner").applyInPandas(
        _answer, "part long, owner long, bitmap binary"
    )
    answers = write_by_part(replies, "answers")

    marked = materialise(_mark(docs, sent, answers, owners), "marked")
    single = marked.where("suspect is null").select(
        "row", "doc_id", "print", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    suspects = marked.where("suspect is not null")
    groups = suspects.groupBy("finger", "suspect").agg(
        F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size")
    )
    # As a table, so that Spark may split a large group's suspects in the join.
    groups = materialise(groups, "groups")
    verified = suspects.join(groups, ["finger", "suspect"]).select(
        "row", "doc_id", "print", F.col("stays.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256",
    )
    return single.unionByName(verified)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = f"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
