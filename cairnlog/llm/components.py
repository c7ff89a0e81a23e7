"""Connected components by alternating large and small stars.

Each round sends every node's neighbours to the smallest neighbour, with a
minimum and a join, never a collected neighbourhood; edges are written to the
shared folder after each round. Rounds grow with the logarithm of the longest
path. No edges: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST_ROUNDS = 60


def _to_smallest(edges: DataFrame, larger: bool) -> DataFrame:
    """For each node, the smallest of it and its neighbours; its larger
    neighbours (or itself and the smaller ones) now hang on that."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if larger:
        near = both.unionAll(back)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b").distinct()
    near = both.where("v < u").unionAll(back.where("v < u"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    moved = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From a, b (long): node and root, the smallest node of its component."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    last = None
    for _ in range(MOST_ROUNDS):
        edges = materialise(_to_smallest(_to_smallest(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components didn't settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
