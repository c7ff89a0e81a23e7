"""JSON lines in and out: soak streams, tagged oracle lines, exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import base64_of
from ..model import LogError
from ..plans.jsonl_view import parsed


def read_soak(spark: SparkSession, path: str) -> DataFrame:
    """key and payload; a file without a line is an error."""
    rows = parsed(spark.read.text(path))
    if rows.isEmpty():
        raise LogError(f"no lines: {path}")
    return rows


def read_oracle(spark: SparkSession, path: str) -> DataFrame:
    """seq, op, key, value from {"op","seq","key","payload"?}."""
    raw = spark.read.schema("op string, seq long, key string, payload string").json(path)
    return raw.select("seq", "op", F.unbase64("key").alias("key"), F.when(F.col("op") == "put", F.unbase64("payload")).alias("value"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """key and value of an export."""
    raw = spark.read.schema("key_b64 string, value_b64 string").json(path)
    return raw.select(F.unbase64("key_b64").alias("key"), F.unbase64("value_b64").alias("value"))


def write_export(log: DataFrame, path: str) -> None:
    """The live pairs, sorted by key, as a folder of text files in order."""
    from ..operators.kv import export_lines

    export_lines(log).orderBy("key").select("line").write.text(path)


def oracle_line(op: str, seq: int, key: bytes, payload: bytes | None = None) -> str:
    import base64
    import json

    row = {"op": op, "seq": seq, "key": base64.b64encode(key).decode()}
    if payload is not None:
        row["payload"] = base64.b64encode(payload).decode()
    return json.dumps(row, separators=(",", ":"))


class OracleWriter:
    """Lines that are on disk before the next operation is tried."""

    def __init__(self, path: str):
        self.f = open(path, "a", encoding="ascii")  # noqa: SIM115

    def add(self, op: str, seq: int, key: bytes, payload: bytes | None = None) -> None:
        self.f.write(oracle_line(op, seq, key, payload) + "\n")
        self.f.flush()
        os.fsync(self.f.fileno())

    def close(self) -> None:
        self.f.close()


def soak_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(base64_of(F.col("key")).alias("key"), base64_of(F.col("payload")).alias("payload"))).alias("value"))
