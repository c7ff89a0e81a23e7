"""Small segments share tasks, and columns say what frames by themselves say."""

import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlog.model import CRC_MISMATCH, LogError
from cairnlog.operators import derive
from cairnlog.sources import datasource, fs
from cairnlog.sources.codec import decode_columns, decode_segment, encode_columns, encode_frame, encode_frames, strings_at
from cairnlog.sources.datasource import read_log

records = st.tuples(st.sampled_from(["Raw", "Put", "Delete"]), st.integers(0, 2**64 - 1), st.binary(max_size=9), st.binary(max_size=700))


@given(st.lists(records, min_size=1, max_size=12), st.integers(0, 2000), st.integers(0, 255), st.integers(0, 40), st.booleans())
@settings(max_examples=150, deadline=None)
def test_columns_are_frames(rows, at, flip, cut, verify):
    types, txids, keys, payloads = zip(*rows)
    out, ends = encode_columns(pa.array(types), np.array(txids, np.uint64), pa.array(keys, pa.binary()), pa.array(payloads, pa.binary()))
    frames = encode_frames(rows)
    assert out.tobytes() == b"".join(frames) and ends.tolist() == np.cumsum([len(f) for f in frames]).tolist()
    data = bytearray(out.tobytes()[: len(out) - cut])
    if at < len(data):
        data[at] ^= flip
    data = bytes(data)
    want, got = decode_segment(data, 0, verify), decode_columns(data, 0, verify)
    assert (got.status, got.offset, got.available, got.needed) == (want.status, want.offset, want.available, want.needed)
    assert got.starts.tolist() == [f.offset for f in want.frames] and got.heads["txid"].tolist() == [f.txid for f in want.frames]
    assert got.sizes.tolist() == [f.len for f in want.frames]
    assert strings_at(data, got.starts, got.sizes).to_pylist() == [data[f.offset : f.offset + f.len] for f in want.frames]


def numbered(spark, n, each, tasks):
    """Rows of so many segments, numbered, several segments a task."""
    segment = F.floor(F.col("id") / each) + 1
    rows = spark.range(n).select(
        (F.col("id") + 1).alias("txid"), segment.cast("long").alias("segment"), F.lit("Put").alias("record_type"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), F.lit(b"x").alias("payload"),
    )
    return rows.repartitionById(tasks, F.floor((segment - 1) * tasks / -(-n // each)).cast("int")).sortWithinPartitions("txid")


def test_tasks_write_and_read_several_segments(spark, tmp_path):
    path = str(tmp_path / "s")
    os.mkdir(path)
    derive.append_numbered(numbered(spark, 2000, 10, 2), path)
    assert [n for n, _, _ in fs.list_segments(path)] == list(range(1, 201))
    df = read_log(spark, path)
    assert df.rdd.getNumPartitions() <= 4  # a task for each would be 200
    got = df.orderBy("segment", "offset").collect()
    assert [(r.segment, int(r.txid), bytes(r.key)) for r in got] == [(k // 10 + 1, k + 1, b"%d" % k) for k in range(2000)]
    derive.append_numbered(numbered(spark, 30, 10, 1).where("segment <> 2"), path)  # behind the last, a gap stays one
    assert [n for n, _, _ in fs.list_segments(path)][-3:] == [200, 201, 203]
    assert int(read_log(spark, path).agg(F.max("txid")).first()[0]) == 2030


def test_segments_of_a_task_must_ascend(spark, tmp_path):
    path = str(tmp_path / "s")
    os.mkdir(path)
    with pytest.raises(Exception, match="segments must ascend"):
        derive.append_numbered(numbered(spark, 30, 10, 1).withColumn("segment", 5 - F.col("segment")), path)
    assert not fs.list_segments(path)


def test_damage_within_a_shared_task(spark, tmp_path):
    path = str(tmp_path / "s")
    os.mkdir(path)
    derive.append_numbered(numbered(spark, 100, 10, 1), path)
    name = f"{path}/{fs.segment_name(4)}"
    data = bytearray(open(name, "rb").read())
    data[-1] ^= 1
    open(name, "wb").write(data)
    rows = read_log(spark, path, mode="frames").where("status <> 'ok'").collect()
    assert [(r.segment, r.status) for r in rows] == [(4, CRC_MISMATCH)]
    assert read_log(spark, path, mode="frames").where("status = 'ok'").count() == 99
    with pytest.raises(LogError, match="segment 4"):
        read_log(spark, path)


def test_parts_are_bounded(monkeypatch):
    parts = [datasource.SegmentPart(n, "", False) for n in range(1, 36_001)]
    many = datasource.shared(parts, [45_000] * len(parts))
    assert len(many) < 200 and [p.segment for s in many for p in s.parts] == list(range(1, 36_001))
    assert max(sum(45_000 for _ in s.parts) for s in many) <= datasource.MOST_BYTES
    assert [len(s.parts) for s in datasource.shared(parts[:3], [1 << 30] * 3)] == [1, 1, 1]  # large segments stay alone
    assert datasource.shared([], []) == [datasource.SharedPart([])]


def test_long_payloads_are_copied_one_by_one():
    rows = [("Put", 1, b"k", b"p" * 5000), ("Raw", 2, b"", bytes(range(256)) * 300)]
    types, txids, keys, payloads = zip(*rows)
    out, ends = encode_columns(pa.array(types), np.array(txids, np.uint64), pa.array(keys, pa.binary()), pa.array(payloads, pa.binary()))
    assert out.tobytes() == b"".join(encode_frame(*r) for r in rows)
    got = decode_columns(out.tobytes())
    assert strings_at(out.tobytes(), got.starts, got.sizes).to_pylist() == [encode_frame(*r) for r in rows]
