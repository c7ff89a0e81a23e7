import io
import json
import os

import pytest
from pyspark.sql import functions as F

from cairnlog.cli import shown
from cairnlog.functions import encoding, render, wire
from cairnlog.functions.crc32c import crc32c, crc32c_column
from cairnlog.model import LogError
from cairnlog.operators import derive, kv, log, validate
from cairnlog.sources import jsonl
from cairnlog.sources import datasource
from cairnlog.sources.codec import HEADER, decode_segment, encode_frame, hop
from cairnlog.sources.datasource import read_log
from cairnlog.sources.store import KeyValueStore, RecordLog
from cairnlog.streaming import incremental


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "s")
    with KeyValueStore(path) as s:
        for i in range(30):
            s.put(b"k%d" % (i % 7), b"v%d" % i)
            if i % 5 == 4:
                s.delete(b"k%d" % (i % 7))
            if i % 10 == 9:
                s.rotate()
        s.log.append(b"raw")
    return path


def pairs(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_source_agrees_with_the_handle(spark, store):
    with KeyValueStore(store) as s:
        want, live, report = s.log.scan(), dict(s.items()), s.log.recovery_report()
        stats_bytes = sum(s.ref_of(k).len for k in live)
    df = read_log(spark, store)
    got = log.in_order(df).collect()
    assert [(r.segment, r.offset, r.len, r.record_type, int(r.txid), bytes(r.key), bytes(r.payload)) for r in got] == [
        (r.segment, r.offset, r.len, r.record_type, r.txid, r.key, r.payload) for r in want
    ]
    assert pairs(kv.items(df)) == live == pairs(kv.items_by_reference(df))
    assert kv.compaction_stats(df).first().bytes_written == stats_bytes
    frames = read_log(spark, store, mode="frames")
    r = log.recovery_report(frames, 4).first()
    assert (r.files_scanned, r.records_replayed, r.tail_truncated, int(r.last_txid_seen)) == (4, report.records_replayed, 0, report.last_txid_seen)


def test_damage_as_rows_and_errors(spark, store):
    with open(os.path.join(store, "00000004.dwal"), "ab") as f:
        f.write(b"12345678")
    frames = read_log(spark, store, mode="frames")
    r = log.recovery_report(frames, 4).first()
    assert (r.tail_truncated, r.tail_bytes_discarded) == (1, 8)
    assert log.verify(frames).first().tail_truncated == 1
    good = read_log(spark, store).count()
    with open(os.path.join(store, "00000002.dwal"), "r+b") as f:
        f.seek(30)
        f.write(b"\xee")
    with pytest.raises(LogError, match="crc_mismatch"):
        read_log(spark, store)
    lazy = read_log(spark, store, mode="lazy")
    part = read_log(spark, store, mode="lazy", from_segment="3")
    assert {r.segment for r in part.select("segment").distinct().collect()} == {3, 4}  # others aren't looked at
    with pytest.raises(Exception, match="crc_mismatch"):
        lazy.count()
    assert good > 0


def test_snapshot_list_is_frozen(spark, store):
    df = read_log(spark, store)
    n = df.count()
    with RecordLog(store) as lg:
        lg.append(b"same segment")
        lg.rotate()
        lg.append(b"new segment")
    assert df.count() == n + 1 and read_log(spark, store).count() == n + 2
    with pytest.raises(LogError):
        read_log(spark, store + "-none")


def test_append_makes_new_segments_with_running_numbers(spark, store):
    with RecordLog(store) as lg:
        last = lg.recovery_report().last_txid_seen
    rows = spark.range(20).select(F.lit("Put").alias("record_type"), F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), F.lit(b"x").alias("payload"))
    derive.append(rows.repartition(3), store)
    with RecordLog(store) as lg:
        found = lg.scan()
        assert [r.txid for r in found[-20:]] == list(range(last + 1, last + 21))
        assert lg.recovery_report().tail_truncated == 0
    assert not [n for n in os.listdir(store) if n.startswith(".staging")]


def test_commit_reads_no_data_file(spark, store, monkeypatch):
    """Tasks write final numbers, so the driver looks at the headers of the last segment alone."""
    opened, hopped = [], datasource.hop
    monkeypatch.setattr(datasource, "_renumber", lambda *a: opened.append(a))
    monkeypatch.setattr(datasource.fs, "read_bytes", lambda *a: opened.append(a))
    monkeypatch.setattr(datasource, "hop", lambda f, *a: opened.append("hop") or hopped(f, *a))
    writer = datasource.LogWriter({"path": store, "bases": json.dumps({0: (0, 2), 1: (2, 1)})}, False)
    base = writer.behind
    made = []
    for task, keys in ((0, ("a", "b")), (1, ("c",))):
        name = f"{store}/{writer.folder}/{task}"
        os.makedirs(os.path.dirname(name), exist_ok=True)
        first = base + 1 + 2 * task
        with open(name, "wb") as f:
            f.write(b"".join(encode_frame("Put", first + k, x.encode(), b"") for k, x in enumerate(keys)))
        made.append(datasource.Written(task, name, len(keys), first, first + len(keys) - 1))
    n = len(opened)
    writer.commit(made[::-1])
    assert opened[n:] == ["hop"] * (len(opened) - n) and len(opened) - n <= 2
    with RecordLog(store) as lg:
        assert [(r.txid, r.key) for r in lg.scan()[-3:]] == [(base + 1, b"a"), (base + 2, b"b"), (base + 3, b"c")]


def test_commit_behind_another_writer_is_refused(spark, store):
    writer = datasource.LogWriter({"path": store}, False, True)
    with RecordLog(store) as lg:
        lg.append(b"meanwhile")
    with pytest.raises(LogError, match="written to since"):
        writer.commit([])


def test_rows_without_numbers_straight_to_the_source(spark, store):
    datasource.register(spark)
    rows = spark.range(12, numPartitions=3).select(F.lit("Put").alias("record_type"), F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), F.lit(b"x").alias("payload"))
    rows.write.format("framedlog").option("path", store).mode("append").save()
    with RecordLog(store) as lg:
        found = [r.txid for r in lg.scan()[-12:]]
        assert found == list(range(found[0], found[0] + 12))


@pytest.mark.parametrize("window", [26, 40, 1 << 16])
def test_hopping_headers_is_decoding(tmp_path, window):
    frames = [encode_frame("Put", k + 5, b"k" * (k % 7), b"x" * (k * 13 % 300)) for k in range(60)]
    data = b"".join(frames)
    for cut in (len(data), len(data) - 1, len(data) - 30, 10, 0):
        got = hop(io.BytesIO(data[:cut]), 0, cut, window=window)
        want = decode_segment(data[:cut])
        assert (got.frames, got.status, got.offset) == (len(want.frames), want.status, want.offset)
        assert got.txid == (want.frames[-1].txid if want.frames else 0)
    part = hop(io.BytesIO(data), 0, len(data), most=500, window=window)
    assert part.status == "ok" and 500 <= part.offset < 500 + 400


def test_stream_by_bytes(spark, store):
    reader = datasource.LogStream({"path": store, "max_bytes_per_trigger": "60"})
    seen = [reader.latestOffset() for _ in range(200)]
    whole = datasource.LogStream({"path": store}).latestOffset()
    assert seen[0] != whole and seen[-1] == whole
    for a, b in zip(seen, seen[1:]):
        assert all(b[n] >= at for n, at in a.items())


def test_append_to_a_torn_store_is_refused(spark, store):
    with open(os.path.join(store, "00000004.dwal"), "ab") as f:
        f.write(b"123")
    rows = spark.createDataFrame([("Put", b"k", b"v")], "record_type string, key binary, payload binary")
    with pytest.raises(Exception, match="torn tail"):
        derive.append(rows, store)


@pytest.mark.parametrize("segments, keys", [(1, 1 << 20), (3, 1 << 20), (3, 2)])
def test_compact_to_matches_the_handle(spark, store, tmp_path, monkeypatch, segments, keys):
    monkeypatch.setattr(derive, "RANGE_KEYS", keys)
    derive.compact_to(read_log(spark, store), str(tmp_path / "c"), segments)
    with KeyValueStore(store) as s:
        s.compact_to(str(tmp_path / "want"))
        live = dict(s.items())
    with KeyValueStore(str(tmp_path / "c")) as c:
        assert dict(c.items()) == live
        assert [r.key for r in c.log.scan()] == sorted(live) and [r.txid for r in c.log.scan()] == list(range(1, len(live) + 1))
    if segments == 1:
        one, two = (open(tmp_path / d / "00000001.dwal", "rb").read() for d in ("c", "want"))
        assert one == two
    with pytest.raises(LogError, match="not empty"):
        derive.compact_to(read_log(spark, store), str(tmp_path / "c"))


def test_compact_of_an_empty_store(spark, tmp_path):
    RecordLog(str(tmp_path / "e")).close()
    df = read_log(spark, str(tmp_path / "e"))
    assert df.count() == 0 and log.next_segment(df).first()[0] == 1
    derive.compact_to(df, str(tmp_path / "c"))
    with RecordLog(str(tmp_path / "c")) as lg:
        assert lg.scan() == []


def test_export_and_read_back(spark, store, tmp_path):
    df = read_log(spark, store)
    jsonl.write_export(df, str(tmp_path / "x"))
    assert pairs(jsonl.read_export(spark, str(tmp_path / "x"))) == pairs(kv.items(df))
    with KeyValueStore(store) as s:
        size = s.export_jsonl(str(tmp_path / "y.jsonl"))
    stats = kv.export_stats(df).first()
    assert stats.bytes_written == size
    assert pairs(jsonl.read_export(spark, str(tmp_path / "y.jsonl"))) == pairs(kv.items(df))


def test_json_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"key":"YQ==","payload":"YWI="}\n\n{"key":"","payload":""}\n')
    assert [(bytes(r.key), bytes(r.payload)) for r in jsonl.read_soak(spark, str(tmp_path / "s.jsonl")).collect()] == [(b"a", b"ab"), (b"", b"")]
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(LogError):
        jsonl.read_soak(spark, str(tmp_path / "e.jsonl"))
    w = jsonl.OracleWriter(str(tmp_path / "o.jsonl"))
    w.add("put", 1, b"a", b"1")
    w.add("del", 2, b"a")
    w.add("put", 3, b"b", b"2")
    w.close()
    ops = jsonl.read_oracle(spark, str(tmp_path / "o.jsonl"))
    got = {bytes(r.key): (r.last_seq, r.puts, r.dels, r.last_op) for r in validate.replay(ops).collect()}
    assert got == {b"a": (2, 1, 1, "del"), b"b": (3, 1, 0, "put")}
    assert validate.dead_count(ops).first().dead == 1
    state = spark.createDataFrame([(b"a", b"1")], "key binary, value binary")
    assert validate.prefix_of(ops, state).first().ok
    wrong = spark.createDataFrame([(b"a", b"1"), (b"b", b"2")], "key binary, value binary")
    assert not validate.prefix_of(ops, wrong).first().ok
    assert validate.prefix_of(ops, state.limit(0)).first().ok


VALUES = [b"", b"plain", b"a b", b'q"\\', b"t\t", b"\x00\x01", b"x" * 70, b"\xff" * 70, "é".encode()]


def test_expressions(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v binary")
    v = F.col("v")
    rows = df.select("v", render.render(v).alias("auto"), render.render(v, "hex").alias("hex"), render.render(v, "base64").alias("b64"),
                     crc32c_column(v).alias("crc"), encoding.fnv1a64(v).alias("fnv")).collect()
    for r in rows:
        data = bytes(r.v)
        assert (r.auto, r.hex, r.b64) == (shown(data), shown(data, "hex"), shown(data, "base64"))
        assert r.crc == crc32c(data)
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        assert r.fnv == f"{h:016x}"
    wanted = spark.createDataFrame([("Put", 258, b"key", b"payload")], "record_type string, txid long, key binary, payload binary")
    got = wanted.select(wire.wire_header(F.col("record_type"), F.col("txid"), F.col("key"), F.col("payload"))).first()[0]
    assert got == encode_frame("Put", 258, b"key", b"payload")[: HEADER.size].hex().upper()


def test_stream_sees_only_whole_frames_and_merges(spark, store, tmp_path):
    view = incremental.ViewWriter(str(tmp_path / "v"))
    where = str(tmp_path / "cp")

    def catch_up():
        q = incremental.stream_log(spark, store).writeStream.foreachBatch(view).option("checkpointLocation", where).trigger(availableNow=True).start()
        q.awaitTermination()
        n = max(int(x[5:]) for x in os.listdir(tmp_path / "v"))
        return pairs(incremental.live(view.current(spark, n)))

    with KeyValueStore(store) as s:
        want = dict(s.items())
    assert catch_up() == want
    frame = encode_frame("Put", 1000, b"new", b"value")
    path = os.path.join(store, "00000004.dwal")
    with open(path, "ab") as f:
        f.write(frame[:20])
    assert catch_up() == want
    with open(path, "ab") as f:
        f.write(frame[20:])
    assert catch_up() == want | {b"new": b"value"}


def test_validation(spark):
    kvs = "key binary, value binary"
    a = spark.createDataFrame([(b"1", b"x"), (b"2", b"y"), (b"4", b"z")], kvs)
    b = spark.createDataFrame([(b"1", b"x"), (b"2", b"q"), (b"3", b"w")], kvs)
    assert {bytes(r.key) for r in validate.extras(a, b).collect()} == {b"4"}
    assert {bytes(r.key): r.state for r in validate.fate(a, b).collect()} == {b"1": "survived", b"2": "mismatch", b"3": "dropped"}
    assert {(bytes(r.key), r.side) for r in validate.symmetric_difference(a, b).collect()} == {(b"4", "left"), (b"3", "right")}
    rows = [(1, 0, 1), (1, 30, 2), (2, 0, 3)]
    ok = spark.createDataFrame(rows, "segment long, offset long, txid long")
    assert validate.contiguous(ok).first().ok
    assert not validate.contiguous(ok.where("txid <> 2")).first().ok
    assert [r.segment for r in log.gaps(spark.createDataFrame([(1,), (4,)], "segment long")).orderBy("segment").collect()] == [2, 3]
