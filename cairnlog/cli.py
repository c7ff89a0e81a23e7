"""Inspection from the command line: python -m cairnlog.cli [--json] COMMAND STORE ...

Commands: scan get report verify dump export compact check. Exit codes: 0 done;
1 the store can't be opened, or bad arguments; 2 a torn tail, or a key that
isn't there; 3 damage met while reading. Every command opens the store as its
only writer. Nothing here starts Spark: a store on one machine is read by the
handle; the DataFrame API serves larger ones.
"""

from __future__ import annotations

import argparse
import base64
import json
import os
import sys
from collections.abc import Sequence

from .functions.encoding import decode_base64, decode_hex
from .model import LogError
from .sources.store import KeyValueStore, RecordLog, Report, records_of

SCHEMA = "cairnlog.cli.v1"
SHOWN = 64
DONE, FAILED, TORN, DAMAGED = 0, 1, 2, 3


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def is_printable(data: bytes) -> bool:
    return all(b == 9 or 32 <= b < 127 for b in data)


def shown(data: bytes, mode: str = "auto", most: int | None = SHOWN) -> str:
    """A field of a line, as functions.render.render has it for columns."""
    head = data if most is None else data[:most]
    dots = "..." if len(head) < len(data) else ""
    if mode == "hex":
        return f"hex:{head.hex()}{dots}"
    if mode == "base64" or not is_printable(data):
        return f"b64:{b64(head)}{dots}"
    text = head.decode()
    if not text or set(text) & set(' \t"\\'):
        text = '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\t", "\\t") + '"'
    return text + dots


def value_text(data: bytes, mode: str, most: int | None) -> tuple[str | None, str | None]:
    """(text, hint): one of them."""
    head = data if most is None else data[:most]
    if mode == "base64":
        return b64(head), None
    if mode == "hex":
        return head.hex(), None
    if not is_printable(data):
        return None, f"<binary value, {len(data)} bytes; use --bytes base64 or --bytes hex>"
    return head.decode(), None


def say(kind: str, fields: dict, as_json: bool, with_kind: bool = False) -> None:
    if as_json:
        print(json.dumps({"schema": SCHEMA, "kind": kind, **fields}, separators=(",", ":"), ensure_ascii=False))
        return
    rows = {"schema": SCHEMA, **({"kind": kind} if with_kind else {}), **fields}
    width = max(map(len, rows)) + 2
    for k, v in rows.items():
        print(f"{k + ':':<{width}}{v}")


def type_text(record_type: str) -> str:
    return {"Raw": "RAW", "Put": "PUT", "Delete": "DEL"}[record_type]


def place_text(r) -> str:
    return f"seg={r.segment:08d} off={r.offset:>10} len={r.len:>8} type={type_text(r.record_type):<3} txid={r.txid:>10}"


def _records(log: RecordLog, report: Report):
    return records_of(log.path, log._list(), report)


def scan(a: argparse.Namespace) -> int:
    most = None if a.no_truncate else SHOWN
    if a.from_offset is not None and a.from_segment is None:
        raise LogError("--from-offset needs --from-segment")
    with RecordLog(a.store) as log:
        left = a.limit
        try:
            for r in _records(log, Report()):
                if left == 0:
                    break
                if a.from_segment is not None and (r.segment, r.offset) < (a.from_segment, a.from_offset or 0):
                    continue
                if a.json:
                    say("record", {
                        "segment": r.segment, "offset": r.offset, "len": r.len, "record_type": r.record_type, "txid": r.txid,
                        "key_base64": b64(r.key), "payload_base64": b64(r.payload),
                    }, True)
                else:
                    print(f"{place_text(r)} key={shown(r.key, a.bytes, most)} payload={shown(r.payload, a.bytes, most)}")
                left = None if left is None else left - 1
        except LogError as e:
            print(f"scan: {e}", file=sys.stderr)
            return DAMAGED
        return TORN if log.recovery_report().tail_truncated else DONE


def dump(a: argparse.Namespace) -> int:
    most = None if a.no_truncate else SHOWN
    with RecordLog(a.store) as log:
        left = a.limit
        try:
            for r in _records(log, Report()):
                if left == 0:
                    break
                sizes = {"key_len": len(r.key), "payload_len": len(r.payload)}
                if a.json:
                    say("frame", {"segment": r.segment, "offset": r.offset, "len": r.len, "record_type": r.record_type, "txid": r.txid, **sizes}, True)
                else:
                    print(f"{place_text(r)} key={shown(r.key, a.bytes, most)} key_len={len(r.key)} payload_len={len(r.payload)}")
                left = None if left is None else left - 1
        except LogError as e:
            print(f"dump: {e}", file=sys.stderr)
            return DAMAGED
    return DONE


def get(a: argparse.Namespace) -> int:
    given = [x for x in (a.key, a.key_base64, a.key_hex) if x is not None]
    if len(given) != 1:
        raise LogError("pass exactly one of --key, --key-base64, or --key-hex")
    if a.key is not None:
        key = a.key.encode()
    else:
        key = decode_base64(a.key_base64) if a.key_base64 is not None else decode_hex(a.key_hex)
    with KeyValueStore(a.store) as s:
        value = s.get(key)
    if value is None:
        say("miss", {"key_base64": b64(key)}, True) if a.json else print("get: key not found", file=sys.stderr)
        return TORN
    if a.json:
        say("value", {"key_base64": b64(key), "value_base64": b64(value), "value_len": len(value)}, True)
    else:
        text, hint = value_text(value, a.bytes, None if a.no_truncate else SHOWN)
        print(text) if hint is None else print(hint, file=sys.stderr)
    return DONE


def report(a: argparse.Namespace) -> int:
    with RecordLog(a.store) as log:
        r = log.recovery_report()
    say("report", vars(r), a.json)
    return TORN if r.tail_truncated else DONE


def verify(a: argparse.Namespace) -> int:
    n = segment = offset = 0
    r = Report()
    with RecordLog(a.store) as log:
        try:
            for x in _records(log, r):
                n, segment, offset = n + 1, x.segment, x.offset
        except LogError as e:
            print(f"verify: {e}", file=sys.stderr)
            return DAMAGED
    say("verify", {
        "frames_checked": n, "crc_failures": 0, "tail_truncated": r.tail_truncated,
        "tail_bytes_discarded": r.tail_bytes_discarded, "last_segment": segment, "last_offset": offset,
    }, a.json)
    return TORN if r.tail_truncated else DONE


def export(a: argparse.Namespace) -> int:
    if os.path.exists(a.outfile):
        print(f"export: refuses to overwrite existing file: {a.outfile}", file=sys.stderr)
        return FAILED
    with KeyValueStore(a.store) as s:
        size = s.export_jsonl(a.outfile)
        n = len(s)
    say("export", {"outfile": a.outfile, "records_written": n, "bytes_written": size}, a.json, True)
    return DONE


def compact(a: argparse.Namespace) -> int:
    if os.path.isdir(a.target) and os.listdir(a.target):
        print(f"compact: target directory is not empty: {a.target}", file=sys.stderr)
        return FAILED
    with KeyValueStore(a.store) as s:
        stats = s.compact_to(a.target)
    say("compact", {"target": a.target, **stats}, a.json, True)
    return DONE


def check(a: argparse.Namespace) -> int:
    with KeyValueStore(a.store) as s:
        try:
            for k in s.keys():
                if s.get(k) is None:
                    raise LogError(f"a listed key has no value: b64:{b64(k)}")
        except LogError as e:
            print(f"check: {e}", file=sys.stderr)
            return DAMAGED
        n, r = len(s), s.log.recovery_report()
    say("check", {
        "keys_checked": n, "tail_truncated": r.tail_truncated, "tail_bytes_discarded": r.tail_bytes_discarded,
        "mid_stream_errors": r.mid_stream_errors, "unsupported_versions": r.unsupported_versions,
    }, a.json, True)
    return TORN if r.tail_truncated or r.mid_stream_errors else DONE


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnlog")
    p.add_argument("--json", action="store_true")
    subs = p.add_subparsers(dest="command", required=True)
    for f in (scan, get, report, verify, dump, export, compact, check):
        s = subs.add_parser(f.__name__)
        s.set_defaults(run=f)
        s.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
        s.add_argument("store")
        if f in (scan, dump, get):
            s.add_argument("--bytes", choices=("auto", "raw", "base64", "hex"), default="auto", type=lambda x: {"b64": "base64"}.get(x, x))
            s.add_argument("--no-truncate", action="store_true")
        if f in (scan, dump):
            s.add_argument("--limit", type=int)
        if f is scan:
            s.add_argument("--from-segment", type=int)
            s.add_argument("--from-offset", type=int)
        if f is get:
            s.add_argument("--key")
            s.add_argument("--key-base64")
            s.add_argument("--key-hex")
        if f is export:
            s.add_argument("outfile")
        if f is compact:
            s.add_argument("target")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return DONE if e.code == 0 else FAILED
    try:
        return a.run(a)
    except (LogError, ValueError, OSError) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
