"""Mixing sources to target weights by a low-discrepancy schedule.

DataFrame functions only. A document's size is its number of words; each
source's documents stand in an order shuffled by hash, end to end, and are cut
into blocks of equally many words. Slot t of the mix has the point
t * golden ratio mod 1 (in 31-bit whole numbers), which falls into one
source's share of the targets; the slot's rank among the source's slots picks
the block, going round the shuffled blocks again when they are used up.

Running totals within a source are formed in two steps, totals of small hash
ranges first, so no task holds a whole source. Targets: weights shared over
all words, a source's target stops at `most` times its size and the rest is
shared by weight again. A source at that limit drops a slot that would start
another round.

Null and empty texts have size 0 and nothing is taken from them. A null source
is a source, the last one. Repeated rows of one id are rows of their own, told
apart by a row number. Empty table, or no words at all: no slots, taken 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise
from .parts import print_of, steady

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Slots ranked at once; hex digits of the hash that make a source's ranges.
SLOT_RANGE, RANGE_DIGITS = 8192, 3
#: 2^31 and the odd number next to 2^31 over the golden ratio.
POINTS, GOLDEN = 2147483648, 1327217885


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From source, source_size (a row for each source): place by code point,
    weight and target. With sources by limit over weight, the first one that
    an equal share of what is left doesn't lift above its limit, and all after
    it, get that share; those before it get their limits."""
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    t = sizes.withColumn("place", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int")).cast("double"))
    t = t.withColumn("limit", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    limits_before = F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    weights_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("level", (whole - F.coalesce(limits_before, F.lit(0.0))) / weights_left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    share = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("share", share)
    return t.select("source", "place", "weight", "source_size", F.least("limit", F.col("weight") * F.col("share")).alias("target"))


def _running(rows: DataFrame, value: str, by: str, group: Column, order: Sequence[str], name: str) -> DataFrame:
    """Sum of value before each row, in `order` within `by`, by way of totals
    of groups that follow the order; totals and rows meet by one exchange."""
    rows = rows.withColumn("group_", group)
    totals = rows.groupBy(by, "group_").agg(F.sum(value).alias("total_"))
    before = Window.partitionBy(by).orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "group_", F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("base_"))
    within = Window.partitionBy(by, "group_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(totals, [by, "group_"])
    return out.withColumn(name, F.col("base_") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("group_", "base_")


def schedule(spark: SparkSession, aims: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, place (of the source) and rank (among its slots): the mix in order.
    The sources' edges, a number for each source, become a literal."""
    found = aims.where("target > 0").orderBy("place").select("place", "target").collect()
    total, upto, edges = sum(r.target for r in found), 0.0, []
    for r in found:
        upto += r.target
        edges.append((int(upto / total * POINTS), r.place))
    slots = spark.range(int(total / block_words + 0.5)).withColumnRenamed("id", "slot")
    point = F.pmod(F.pmod(F.col("slot"), F.lit(POINTS)) * GOLDEN, F.lit(POINTS))
    listed = F.array(*(F.struct(F.lit(u).cast("long").alias("upto"), F.lit(p).alias("place")) for u, p in edges)) if edges else None
    if listed is None:
        return slots.select("slot", F.lit(0).alias("place"), F.lit(0).cast("long").alias("rank"))
    slots = slots.withColumn("point", point)
    hit = F.get(F.filter(listed, lambda e: e["upto"] > F.col("point")), F.lit(0))["place"]
    slots = slots.select("slot", F.coalesce(hit, F.lit(edges[-1][1])).alias("place"), F.lit(1).cast("long").alias("one"))
    ranked = _running(slots, "one", "place", F.floor(F.col("slot") / SLOT_RANGE), ["slot"], "rank")
    return ranked.select("slot", "place", "rank")


def _laid_out(docs: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with place, source_size, target and the words before them in their
    source's shuffled order; and the targets."""
    steady(docs.sparkSession)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), key.alias("shuffled"),
        print_of().alias("print"),
    )
    rows = materialise(rows, "sized")
    aims = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "aims")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    rows = rows.alias("l").join(aims.alias("r"), same).select("l.*", "r.place", "r.source_size", "r.target")
    group = F.conv(F.substring("shuffled", 1, RANGE_DIGITS), 16, 10).cast("long")
    return materialise(_running(rows, "size", "place", group, ["shuffled", "row"], "begin").drop("shuffled"), "begun"), aims


def _copies(begun: DataFrame) -> DataFrame:
    """row, print, place, size, begin, source_size and times: how often each row
    with words stands in the mix."""
    rows = begun.where("size > 0")
    rows = rows.withColumn("aim", F.greatest(F.round("target").cast("long"), F.lit(1)))
    rows = rows.withColumn("part", F.expr("greatest(0L, least(size, aim % source_size - begin))"))
    rows = rows.withColumn("is_cut", F.expr("part > 0 AND part < size"))
    rows = rows.withColumn("times", F.expr("aim div source_size + CAST(2 * part >= size AS BIGINT)"))
    cut = rows.where("is_cut").select(
        "place", F.col("begin").alias("cut_begin"), F.expr("begin + size").alias("cut_end"), F.expr("part - IF(2 * part >= size, size, 0L)").alias("owed")
    )
    rows = rows.join(cut, "place", "left")
    more = F.expr("begin >= cut_end AND 2 * (begin - cut_end) + size <= 2 * owed")
    less = F.expr("begin + size <= cut_begin AND 2 * (cut_begin - begin - size) + size <= -2 * owed")
    change = F.when(more, 1).when(less, -1).otherwise(0)
    rows = rows.select("row", "print", "place", "size", "begin", "source_size", "is_cut", (F.col("times") + change).alias("times"))
    given = rows.groupBy("place").agg(F.sum("times").alias("given"))
    rows = rows.join(given, "place").withColumn("times", F.expr("IF(given = 0 AND is_cut, 1L, times)").cast("int"))
    return rows.drop("is_cut", "given")


def arranged(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """row, print (of the input row) and turns, a row for each row of the input;
    and the number of slots. A turn is a copy's slot of the schedule, its source's
    place and the words before it in its source; turns sort to the mix's order.

    Every source gives its whole target, to the word: full rounds of its
    documents and then as many words of the shuffled order as are left. One
    document is cut by that end and stands rounded; the words it then lacks, or
    has too many, are made up by the documents behind, or before, it as far as
    they fit. A source with a positive target gives one document at least.

    These whole documents stand end to end and are spread over the source's
    slots by words: a document begins in the slot that its first word falls into.
    A source of so few words that it has no slot begins in one by its place."""
    spark = docs.sparkSession
    begun, aims = _laid_out(docs, weights, most)
    rows = _copies(begun)
    slots = materialise(schedule(spark, aims, block_words), "slots")
    n = max(1, slots.count())
    each = rows.where("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    each = materialise(each.select("row", "place", "size", F.expr("nth * source_size + begin").alias("before")), "turns")
    facts = each.groupBy("place").agg(F.max(F.col("before") + F.col("size")).alias("words"))
    facts = facts.join(slots.groupBy("place").agg(F.count(F.lit(1)).alias("slots")), "place", "left")
    each = each.join(F.broadcast(facts), "place").withColumn("rank", F.expr("CAST(floor(CAST(before AS DOUBLE) * slots / words) AS BIGINT)"))
    each = each.join(slots, ["place", "rank"], "left")
    slot = F.coalesce("slot", F.pmod(F.xxhash64("place"), F.lit(n)))
    turns = each.groupBy("row").agg(F.collect_list(F.struct(slot.alias("slot"), "place", "before")).alias("turns"))
    return begun.select("row", "print").join(turns, "row", "left"), n


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row (monotonically_increasing_id of the input), doc_id, source, size,
    source_size, target and taken, a row for each document."""
    spark = docs.sparkSession
    begun, aims = _laid_out(docs, weights, most)
    facts = aims.select("place", F.ceil(F.col("source_size") / block_words).alias("blocks"))
    turns = schedule(spark, aims, block_words).join(facts, "place").where(F.col("rank") < most * F.col("blocks"))
    turns = turns.groupBy("place", F.pmod("rank", "blocks").alias("block")).agg(F.count(F.lit(1)).alias("turns"))

    end = F.col("begin") + F.col("size")
    blocks = F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))
    parts = begun.where("size > 0").select("place", "row", "begin", "size", F.explode(blocks).alias("block"))
    inside = F.least(end, (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    parts = parts.select("place", "row", "block", inside.alias("inside"))
    taken = parts.join(turns, ["place", "block"]).groupBy("row").agg(F.sum(F.col("inside") * F.col("turns")).alias("taken"))
    out = begun.join(taken, "row", "left")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((place - 1) % 3 + 1)::INT] AS weight,
         source_size::DOUBLE * {MOST} AS lim
  FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER (
             ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), a AS (
  SELECT source, place, source_size, least(lim, weight * (
           SELECT level FROM l WHERE level * weight <= lim ORDER BY lim / weight, place LIMIT 1)) AS target,
         CAST(ceil(source_size / {BLOCK_WORDS}.0) AS BIGINT) AS blocks
  FROM l
), e AS (
  SELECT place, CAST(floor(sum(target) OVER (ORDER BY place) / (SELECT sum(target) FROM a) * {POINTS}) AS BIGINT) AS upto
  FROM a WHERE target > 0
), e2 AS (
  SELECT place, coalesce(lag(upto) OVER (ORDER BY place), 0) AS since,
         CASE WHEN place = (SELECT max(place) FROM e) THEN {POINTS} ELSE upto END AS upto
  FROM e
), t AS (
  SELECT slot, (slot % {POINTS}) * {GOLDEN} % {POINTS} AS point
  FROM (SELECT unnest(range(CAST(floor((SELECT sum(target) FROM a) / {BLOCK_WORDS} + 0.5) AS BIGINT))) AS slot)
), r AS (
  SELECT e2.place, row_number() OVER (PARTITION BY e2.place ORDER BY slot) - 1 AS rank
  FROM t JOIN e2 ON point >= since AND point < upto
), n AS (
  SELECT r.place, rank % blocks AS block, count(*) AS turns
  FROM r JOIN a ON a.place = r.place WHERE rank < {MOST} * blocks GROUP BY 1, 2
), b AS (
  SELECT d.doc_id, d.size, a.place, a.source_size, a.target,
         CAST(sum(d.size) OVER (PARTITION BY a.place ORDER BY k) - d.size AS BIGINT) AS began
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source
), p AS (
  SELECT *, unnest(range(began // {BLOCK_WORDS}, (began + size - 1) // {BLOCK_WORDS} + 1)) AS block
  FROM b WHERE size > 0
), q AS (
  SELECT doc_id, CAST(sum((least(began + size, (p.block + 1) * {BLOCK_WORDS}) - greatest(began, p.block * {BLOCK_WORDS}))
                          * n.turns) AS BIGINT) AS taken
  FROM p JOIN n ON n.place = p.place AND n.block = p.block GROUP BY doc_id
)
SELECT b.doc_id, CAST(b.size AS BIGINT) AS size, b.source_size, b.target, coalesce(q.taken, 0) AS taken
FROM b LEFT JOIN q ON q.doc_id = b.doc_id
"""
