"""The reference's stores, rebuilt, and what must be found in them; a small soak."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from cairnlog.functions import splitmix
from cairnlog.model import LogError
from cairnlog.operators import kv
from cairnlog.operators.workload import counters
from cairnlog.sources.datasource import read_log, segment_digests
from cairnlog.sources.store import KeyValueStore, LogReader, RecordLog, replace_store
from cairnlog.streaming import incremental


def sizes(path):
    return [os.path.getsize(os.path.join(path, n)) for n in sorted(os.listdir(path)) if n[0] != "."]


def edit(path, n, at, data):
    with open(os.path.join(path, f"{n:08d}.dwal"), "r+b") as f:
        f.seek(at)
        f.write(data)


def test_valid_log(spark, tmp_path):
    path = str(tmp_path / "s")
    with RecordLog(path) as log:
        for x in (b"alpha", b"beta", b"gamma"):
            log.append(x)
    assert sizes(path) == [98] and [bytes(r.payload) for r in read_log(spark, path).orderBy("offset").collect()] == [b"alpha", b"beta", b"gamma"]
    d = segment_digests(spark, path).collect()
    data = open(os.path.join(path, "00000001.dwal"), "rb").read()
    assert [(r.name, r.bytes, r.sha256) for r in d] == [("00000001.dwal", 98, hashlib.sha256(data).hexdigest())]


def test_bad_crc_and_version(tmp_path):
    path = str(tmp_path / "s")
    with RecordLog(path) as log:
        log.append(b"good")
        log.rotate()
        log.append(b"this-will-be-corrupted")
        log.rotate()
        log.append(b"after")
    assert sizes(path) == [32, 50, 33]
    edit(path, 2, 29, b"\x00")
    with pytest.raises(LogError, match="crc"):
        RecordLog(path)
    other = str(tmp_path / "v")
    with RecordLog(other) as log:
        log.append(b"first")
    edit(other, 1, 4, b"\xca\xfe")
    with pytest.raises(LogError, match="version"):
        RecordLog(other)


def test_tombstone_and_compaction_output(spark, tmp_path):
    path = str(tmp_path / "s")
    with KeyValueStore(path) as s:
        s.put(b"alpha", b"1")
        s.put(b"beta", b"2")
        s.put(b"alpha", b"3")
        s.delete(b"beta")
    assert sizes(path) == [133]
    df = read_log(spark, path)
    assert [(bytes(r.key), bytes(r.value)) for r in kv.items(df).collect()] == [(b"alpha", b"3")]
    other = str(tmp_path / "c")
    with KeyValueStore(str(tmp_path / "t")) as s:
        for k, v in ((b"keep", b"old"), (b"gone", b"x"), (b"keep", b"final"), (b"other", b"value")):
            s.put(k, v)
        s.delete(b"gone")
        s.compact_to(other)
    assert sizes(other) == [75]


def test_gaps_and_empty_last_segment(spark, tmp_path):
    path = str(tmp_path / "s")
    with RecordLog(path) as log:
        for x in (b"a", b"b", b"c"):
            log.append(x)
            log.rotate()
    os.unlink(os.path.join(path, "00000002.dwal"))
    assert LogReader(path).segments == [1, 3, 4]
    assert read_log(spark, path).count() == 2


def test_large_numbers_survive(spark, tmp_path):
    from cairnlog.sources.codec import encode_frame

    (tmp_path / "00000001.dwal").write_bytes(encode_frame("Put", 2**64 - 1, b"", b"") + encode_frame("Delete", 5, b"k", b"payload"))
    rows = read_log(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(int(r.txid), r.record_type, bytes(r.payload)) for r in rows] == [(2**64 - 1, "Put", b""), (5, "Delete", b"payload")]


def test_splitmix_vector():
    # The first numbers of seed 1234567, as published with the generator.
    assert splitmix.words(1234567, 3).tolist() == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    rows = splitmix.stream(*splitmix.SOAK["small"])
    assert len(rows) == 100 and {(len(k), len(v)) for k, v in rows} == {(32, 512)}
    assert rows[1][0] == splitmix.words(splitmix.SOAK["small"][0], 4, after=68).astype("<u8").tobytes()


def test_small_soak_ends_as_its_oracle(spark, tmp_path):
    streams = {k: splitmix.stream(seed, rows, key, min(payload, 3072)) for k, (seed, rows, key, payload) in splitmix.SOAK.items()}
    path, want, rotates = str(tmp_path / "s"), {}, 0
    s = KeyValueStore(path)
    for i in range(600):
        spot = i * 2654435761 % 100
        rows = streams["small" if spot < 70 else "medium" if spot < 95 else "large"]
        k, v = rows[i % len(rows)]
        if i % 23 == 22:
            s.delete(k)
            want.pop(k, None)
        else:
            s.put(k, v)
            want[k] = v
        if i % 150 == 149:
            s.rotate()
            rotates += 1
        if i == 400:
            s.close()
            replace_store(path)
            s = KeyValueStore(path)
            rotates = 0
    assert dict(s.items()) == want
    s.close()
    df = read_log(spark, path)
    assert {bytes(r.key): bytes(r.value) for r in kv.items(df).collect()} == want
    assert counters(df).first().live_keys == len(want)


def test_stateful_view(spark, tmp_path):
    path = str(tmp_path / "s")
    with KeyValueStore(path) as s:
        for i in range(20):
            s.put(b"k%d" % (i % 4), b"v%d" % i)
        s.delete(b"k1")
        want = dict(s.items())
    changes = incremental.live_changes(incremental.stream_log(spark, path))
    q = changes.writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("changes").groupBy("key").agg(F.max_by(F.struct("record_type", "value"), "at").alias("s"))
    got = {bytes(r.key): bytes(r.s.value) for r in last.where("s.record_type = 'Put'").collect()}
    assert got == want
