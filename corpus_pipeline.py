"""From raw documents to packed training sequences, in five stages.

toxicity       documents that the chain's score calls toxic go
exact dedup    one row of each group of equal texts stays, the largest id
near copies    one document of each component of the 5-word Jaccard join at 0.8 stays
mixing         each source gives its whole target, in whole documents, in the order of
               the schedule's slots; each file is a stretch of the mix
packing        ids cut into power-of-two sequences

Every stage but the last returns the columns of the documents. Nulls, empty
texts, ties and empty tables behave as the operators say; a document without
words isn't in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import bpe
from cairnlog.llm.common import materialise, unused
from cairnlog.llm.exact_dedup import exact_dedup
from cairnlog.llm.jaccard import similar
from cairnlog.llm.mixing import arranged
from cairnlog.llm.packing import pack
from cairnlog.llm.parts import keep_rows, print_of
from cairnlog.llm.toxicity import annotate, fit

#: Near copies: words of a shingle, least similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
TOXIC = 0.5
#: Slots of the mix in a file.
FILE_SLOTS = 8192


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = unused(docs, "toxic_score")
    scored = annotate(docs, fit(docs, labels), score)
    return scored.where(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, exact_dedup(docs), "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, similar(docs, NEAR_WORDS, NEAR_PERCENT), "stays")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, mark, told, turns, turn = (unused(docs, c) for c in ("row", "print", "told", "turns", "turn"))
    listed, slots = arranged(docs)
    listed = listed.select(F.col("row").alias(row), F.col("print").alias(told), F.col("turns").alias(turns))
    found = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(mark, print_of()).join(listed, row, "left")
    # Row numbers of two scans: a row without its partner, or with another one, ends the job.
    same = F.coalesce(F.col(mark) == F.col(told), F.lit(False))
    changed = F.raise_error(F.lit("the input's partitions changed between two passes")).cast(found.schema[turns].dataType)
    found = found.withColumn(turn, F.explode(F.when(same, F.col(turns)).otherwise(changed)))
    # Each partition is a stretch of the mix, in its order.
    n = -(-slots // FILE_SLOTS)
    stretch = F.expr(f"CAST({turn}.slot * {n} div {slots} AS INT)")
    return found.select(*docs.columns, turn).repartitionById(n, stretch).sortWithinPartitions(turn).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs, bpe.vocabulary())
    return pieces.withColumn("ids_crc32", F.crc32("tokens")).withColumn("offset", F.lit(0).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The field's scores, the ids and the mix's turns have no SQL; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
