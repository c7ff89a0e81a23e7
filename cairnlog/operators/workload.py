"""Schedules and counters of the soak and power-loss workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the workloads.
SPREAD = 2654435761
SHARES = (("small", 70), ("medium", 95))
KEY_FACTOR, KEY_MASK, DELETE_EVERY = 0x100000001B3, 0xFFF, 23


def stream_size(i: Column) -> Column:
    """Which payload stream the i-th operation takes from, by weight. Only the
    product's last two digits matter, so it is formed from small remainders."""
    spot = F.pmod(F.pmod(i, F.lit(100)) * (SPREAD % 100), F.lit(100))
    return F.when(spot < SHARES[0][1], SHARES[0][0]).when(spot < SHARES[1][1], SHARES[1][0]).otherwise("large")


def schedule(ops: DataFrame, number: str) -> DataFrame:
    """op and key_id of each operation. The mask keeps 12 bits, so the factor's suffice."""
    i = F.col(number)
    return ops.withColumn("op", F.when(F.pmod(i, F.lit(DELETE_EVERY)) == DELETE_EVERY - 1, "del").otherwise("put")).withColumn(
        "key_id", (i.bitwiseAND(F.lit(KEY_MASK)) * (KEY_FACTOR & KEY_MASK)).bitwiseAND(F.lit(KEY_MASK))
    )


def counters(log: DataFrame) -> DataFrame:
    """puts, deletes, rotates, bytes written and live keys of a log."""
    from .kv import keydir

    n = log.agg(
        F.count_if(F.col("record_type") == "Put").alias("puts"), F.count_if(F.col("record_type") == "Delete").alias("deletes"),
        (F.count_distinct("segment") - 1).alias("rotates"), F.sum("len").alias("bytes_written"),
    )
    live = keydir(log).agg(F.count(F.lit(1)).alias("live_keys"))
    one = F.lit(1)
    return n.withColumn("one", one).join(live.withColumn("one", one), "one").drop("one")


def payload_index(text: Column) -> Column:
    """The number in a payload of the crash workload."""
    return F.regexp_extract(text, r"^payload-(\d{8})", 1).cast("long")
