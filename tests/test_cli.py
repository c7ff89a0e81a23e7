import base64
import json
import os

import pytest

from cairnlog.cli import main, shown, value_text
from cairnlog.sources.store import KeyValueStore, RecordLog


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "s")
    with KeyValueStore(path) as s:
        for k, v in ((b"alpha", b"1"), (b"beta", b"22"), (b"gamma", b"333"), (b"delta", b"4444")):
            s.put(k, v)
        s.delete(b"beta")
        s.put(b"bin", b"\x00\xff")
    return path


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_scan(store, capsys):
    assert main(["--json", "scan", store]) == 0
    got = lines(capsys)
    assert [x["record_type"] for x in got] == ["Put"] * 4 + ["Delete", "Put"]
    assert list(got[0]) == ["schema", "kind", "segment", "offset", "len", "record_type", "txid", "key_base64", "payload_base64"]
    assert main(["scan", store, "--limit", "2"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "seg=00000001 off=         0 len=      34 type=PUT txid=         1 key=alpha payload=1"
    assert main(["scan", store, "--limit", "0"]) == 0 and capsys.readouterr().out == ""
    assert main(["--json", "scan", store, "--from-segment", "1", "--from-offset", "34"]) == 0
    assert [x["txid"] for x in lines(capsys)] == [2, 3, 4, 5, 6]
    assert main(["scan", store, "--from-offset", "34"]) == 1


def test_get(store, capsys):
    assert main(["get", store, "--key", "gamma"]) == 0 and capsys.readouterr().out == "333\n"
    assert main(["get", store, "--key", "beta"]) == 2
    assert main(["--json", "get", store, "--key-hex", "616c706861"]) == 0
    out = capsys.readouterr()
    assert json.loads(out.out)["value_base64"] == base64.b64encode(b"1").decode()
    assert main(["get", store, "--key", "bin"]) == 0
    out = capsys.readouterr()
    assert out.out == "" and out.err == "<binary value, 2 bytes; use --bytes base64 or --bytes hex>\n"
    assert main(["get", store, "--key", "bin", "--bytes", "b64"]) == 0 and capsys.readouterr().out == "AP8=\n"
    assert main(["get", store, "--key", "bin", "--bytes", "hex"]) == 0 and capsys.readouterr().out == "00ff\n"
    for bad in (["--key-hex", "abc"], ["--key-hex", "zz"], ["--key-base64", "YQ"], [], ["--key", "a", "--key-hex", "61"]):
        assert main(["get", store, *bad]) == 1


def test_reports(store, capsys):
    assert main(["--json", "report", store]) == 0
    got = lines(capsys)[0]
    assert (got["kind"], got["files_scanned"], got["records_replayed"], got["last_txid_seen"]) == ("report", 1, 6, 6)
    assert main(["--json", "verify", store]) == 0
    got = lines(capsys)[0]
    assert (got["frames_checked"], got["last_segment"]) == (6, 1)
    assert main(["--json", "check", store]) == 0
    assert lines(capsys)[0]["keys_checked"] == 4
    assert main(["--json", "dump", store, "--limit", "1"]) == 0
    assert lines(capsys)[0] | {"schema": ""} == {
        "schema": "", "kind": "frame", "segment": 1, "offset": 0, "len": 34, "record_type": "Put", "txid": 1, "key_len": 5, "payload_len": 1,
    }


def test_torn_tail_exit_codes(store, capsys):
    with open(os.path.join(store, "00000001.dwal"), "ab") as f:
        f.write(b"12345678")
    for command, code in (("scan", 2), ("report", 2), ("verify", 2), ("check", 2), ("dump", 0)):
        assert main([command, store]) == code, command


def test_export_and_compact_refuse(store, tmp_path, capsys):
    out, target = str(tmp_path / "x.jsonl"), str(tmp_path / "c")
    assert main(["--json", "export", store, out]) == 0
    got = lines(capsys)[0]
    assert got["records_written"] == 4 and got["bytes_written"] == os.path.getsize(out)
    assert main(["export", store, out]) == 1
    assert main(["--json", "compact", store, target]) == 0
    assert lines(capsys)[0]["live_keys"] == 4
    assert main(["compact", store, target]) == 1


def test_bad_stores(tmp_path, capsys):
    assert main(["report", str(tmp_path / "new")]) == 0  # created
    (tmp_path / "file").write_text("x")
    assert main(["report", str(tmp_path / "file")]) == 1
    log = RecordLog(str(tmp_path / "held"))
    assert main(["report", str(tmp_path / "held")]) == 1
    log.close()
    assert main(["nonsense"]) == 1


@pytest.mark.parametrize(
    "data, want",
    [
        (b"plain", "plain"), (b"", '""'), (b"a b", '"a b"'), (b'q"', '"q\\""'), (b"t\t\\", '"t\\t\\\\"'), (b"\x00", "b64:AA=="),
        (b"x" * 65, "x" * 64 + "..."), (b"\xff" * 70, "b64:" + base64.b64encode(b"\xff" * 64).decode() + "..."),
    ],
)
def test_shown(data, want):
    assert shown(data) == want


def test_value_text_is_cut_without_dots():
    assert value_text(b"x" * 70, "auto", 64) == ("x" * 64, None)
    assert value_text(b"ab", "hex", None) == ("6162", None)
