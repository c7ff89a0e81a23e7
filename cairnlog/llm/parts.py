"""Side tables that a task reads by its own partition's number.

A second pass over the same input can be told something about each of its
rows without moving the rows: what it should know is written to the shared
folder by partition number, and the task reads only its own part. The input
must fall into the same partitions again. `steady` sees to that where files
are read, though executors come and go between the passes; and each pass
compares what it reads with what the first one saw: the number of rows of its
partition, and a hash of id and text of each row it was told about. A
difference raises, it never gives other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import canonical, filesystem, shared_dir, unused

#: Partitions that share a folder; bits of a row number below the partition's.
FOLDER_PARTS, ROW_BITS = 64, 33
LEAST_FILES = "spark.sql.files.minPartitionNum"


def steady(spark: SparkSession) -> None:
    """Fix into how many splits files are cut for the rest of the session, at
    what the cluster has now; unset, it would follow the live cores."""
    if spark.conf.get(LEAST_FILES, None) is None:
        now = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set(LEAST_FILES, str(max(1, int(now))))


def print_of() -> Column:
    """64 bits of a row's id and text, the same in every pass."""
    return F.xxhash64(*canonical())


def row_id(part: int, index: int) -> int:
    """The same number that monotonically_increasing_id() gives."""
    return (part << ROW_BITS) + index


def write_by_part(rows: DataFrame, name: str, gather: bool = True) -> str:
    """Rows with a column `part`; the folder's name. Rows that the part's own
    task makes lie together already and need no gathering."""
    path = shared_dir(rows.sparkSession, name)
    rows = rows.withColumn("folder", F.floor(F.col("part") / FOLDER_PARTS))
    (rows.repartition("part") if gather else rows).write.partitionBy("folder").parquet(path)
    return path


def read_part(uri: str, part: int, columns: list[str], block: int | None = None) -> list[dict]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, at = filesystem(f"{uri}/folder={part // FOLDER_PARTS}")
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return []
    mine = ds.field("part") == part
    if block is not None:
        mine = mine & (ds.field("block") == block)
    return ds.dataset(at, filesystem=files, format="parquet").to_table(columns=columns, filter=mine).to_pylist()


def rows_by_part(rows: DataFrame, name: str) -> str:
    """From row and print: a side table of the rows that matter in each
    partition. Rows whose print is null only tell how many rows there are."""
    part, index = F.shiftright("row", ROW_BITS), F.col("row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    chosen = F.when(F.col("print").isNotNull(), F.struct(index.alias("at"), "print"))
    told = rows.groupBy(part.alias("part")).agg((F.max(index) + 1).alias("rows"), F.collect_set(chosen).alias("told"))
    return write_by_part(told, name)


def ends(rows: DataFrame) -> DataFrame:
    """The last row of each partition, without print: beside the rows that
    matter it tells `rows_by_part` how many there are."""
    last = rows.groupBy(F.shiftright("row", ROW_BITS)).agg(F.max("row").alias("row"))
    return last.select("row", F.lit(None).cast("long").alias("print"))


class Own:
    """What a task is told about the rows of its partition."""

    def __init__(self, uri: str, part: int):
        found = read_part(uri, part, ["rows", "told"])
        self.rows = found[0]["rows"] if found else 0
        self.prints = {x["at"]: x["print"] for r in found for x in r["told"]}

    def has(self, at: int, seen: int) -> bool:
        told = self.prints.get(at)
        if told is not None and told != seen:
            self.changed()
        return told is not None

    def done(self, rows: int) -> None:
        if rows != self.rows:
            self.changed()

    def changed(self) -> None:
        raise ValueError("the input's partitions changed between two passes")


def keep_rows(docs: DataFrame, rows: DataFrame, keep: str) -> DataFrame:
    """The input's rows that are marked in `rows` (row, print and the mark, a
    row for every row of the input), all columns, without a shuffle. The input
    must be a table read from files: what is read of its columns doesn't
    change how its rows are dealt then."""
    wanted = rows_by_part(rows.select("row", F.when(F.col(keep), F.col("print")).alias("print")), "kept")
    mark = unused(docs, "print")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Own(wanted, TaskContext.get().partitionId())
        seen = 0
        for b in it:
            at = b.schema.get_field_index(mark)
            prints = b.column(at).to_pylist()
            yield b.filter(pa.array([mine.has(seen + i, p) for i, p in enumerate(prints)], pa.bool_())).drop_columns([mark])
            seen += b.num_rows
        mine.done(seen)

    return docs.withColumn(mark, print_of()).mapInArrow(run, docs.schema)
