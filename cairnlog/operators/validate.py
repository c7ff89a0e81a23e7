"""Comparisons of a recovered store with what it should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extras(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed keys that aren't expected."""
    return observed.select("key").join(expected.select("key"), "key", "left_anti")


def fate(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """For each expected pair: survived, dropped or mismatch."""
    seen = observed.select("key", F.col("value").alias("seen"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "dropped").when(F.col("seen") == F.col("value"), "survived").otherwise("mismatch")
    return expected.select("key", "value").join(seen, "key", "left").select("key", state.alias("state"))


def fate_counts(observed: DataFrame, expected: DataFrame) -> DataFrame:
    return fate(observed, expected).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys that only one side has, and which."""
    a = left.select("key", F.lit(True).alias("in_left"))
    b = right.select("key", F.lit(True).alias("in_right"))
    only = a.join(b, "key", "full_outer").where("in_left is null or in_right is null")
    return only.select("key", F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("side"))


def contiguous(log: DataFrame) -> DataFrame:
    """Do numbers run from 1 without a gap in physical order? Each segment's
    numbers must be its first one and so on, and start after those before."""
    by = Window.partitionBy("segment").orderBy("offset")
    step = log.select("segment", "txid", (F.col("txid") - F.row_number().over(by)).alias("base"))
    each = step.groupBy("segment").agg(F.min("base").alias("lo"), F.max("base").alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("before", before)  # a row for each segment
    return each.agg(F.coalesce(F.bool_and((F.col("lo") == F.col("before")) & (F.col("hi") == F.col("before"))), F.lit(True)).alias("ok"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def replay(ops: DataFrame) -> DataFrame:
    """Oracle lines (seq, op put or del, key, value): last number and counts of each key."""
    return ops.groupBy("key").agg(
        F.max("seq").alias("last_seq"), F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "del").alias("dels"),
        F.max_by("op", "seq").alias("last_op"), F.max_by("value", "seq").alias("value"),
    )


def dead_count(ops: DataFrame) -> DataFrame:
    return replay(ops).agg(F.count_if(F.col("last_op") == "del").alias("dead"))


def prefix_of(ops: DataFrame, observed: DataFrame) -> DataFrame:
    """Is the observed store what the operations up to some number give? For
    each key the numbers during which its observed state held; the latest
    start over all keys must lie before the earliest end. One row: ok, at."""
    by = Window.partitionBy("key").orderBy("seq")
    spans = ops.select("key", "op", "value", "seq", F.lead("seq").over(by).alias("until"), F.lit(True).alias("known"))
    first = ops.groupBy("key").agg(F.min("seq").alias("until"))
    none = first.select("key", F.lit("del").alias("op"), F.lit(None).cast("binary").alias("value"), F.lit(0).cast("long").alias("seq"), "until", F.lit(True).alias("known"))
    states = none.unionByName(spans)
    seen = observed.select("key", F.col("value").alias("seen"), F.lit(True).alias("there"))
    both = states.join(seen, "key", "full_outer")
    holds = F.when(F.col("there").isNull(), F.col("op") == "del").otherwise((F.col("op") == "put") & (F.col("value") == F.col("seen")))
    # A key may hold its state several times: keep each span, and find a number in one span of every key.
    good = both.where(F.coalesce(F.col("known") & holds, F.lit(False))).select("key", F.col("seq").alias("since"), "until")
    n_keys = both.select(F.count_distinct("key").alias("keys"))
    events = good.select(F.col("since").alias("at"), F.lit(1).alias("d")).unionAll(good.where("until is not null").select(F.col("until").alias("at"), F.lit(-1).alias("d")))
    steps = events.groupBy("at").agg(F.sum("d").alias("value"))
    from .order import running

    held = running(steps, "at", "value").select("at", (F.col("before") + F.col("value")).alias("holding"))
    best = held.agg(F.max("holding").alias("most"), F.max_by("at", F.struct("holding", "at")).alias("at"))
    one = F.lit(1)
    joined = best.withColumn("one", one).join(n_keys.withColumn("one", one), "one")
    ok = F.coalesce(F.col("most") == F.col("keys"), F.col("keys") == 0)
    return joined.select(ok.alias("ok"), F.when(ok, F.coalesce("at", F.lit(0))).alias("at"))
