"""The data source "framedlog": stores as DataFrames, DataFrames as segments,
and a growing store as a stream.

Reading, neighbouring segments share a task up to a bound of bytes; a segment
isn't split. Options:

    path        folder of the store (or a URI)
    segments    comma-joined list to read instead of the folder's (a snapshot)
    since       segment:offset,... to start within segments
    from_segment, to_segment
                bounds on the segments that are read. They are options, not
                pushed filters: the session keeps what a reader was told for
                the next plan over the same DataFrame, whose filter may differ
    mode        strict (default): any damage but a torn tail of the last segment
                raises, and bounds leave no segment out; lazy: the same, but
                segments beyond the bounds aren't looked at; frames: damage is
                a row with its status
    verify_crc  true (default) or false
    payload     true (default), or false for null payloads
    whole       true (default), or false to leave out whole frames once they are
                checked, so that frames are rows of damage alone

Writing, each task makes whole new segments; rows are record_type, key,
payload, and the number as txid where the caller has it (`derive` counts first
where it hasn't). A task's rows are one segment, or with a column segment (from
1, behind the store's last one, ascending over tasks) as many as it tells. Tasks
sync what they wrote; commit() renames.

Streaming, max_bytes_per_trigger ends a micro-batch at the first frame past it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..model import CRC_MISMATCH, FRAME_SCHEMA, HEADER_BYTES, LOG_SCHEMA, OK, RECORD_TYPES, TRUNCATED, LogError
from . import fs
from .codec import decode_columns, decode_segment, encode_columns, encode_frames, hop, strings_at

BATCH_BYTES = 8 << 20
#: Bytes of a reading task: a share of the whole within two bounds. A file counts as so many more.
SHARES, LEAST_BYTES, MOST_BYTES, FILE_BYTES = 64, 1 << 20, 16 << 20, 1 << 14
LOG_ARROW = pa.schema(
    [
        ("segment", pa.int64()), ("offset", pa.int64()), ("len", pa.int64()), ("record_type", pa.string()),
        ("txid", pa.decimal128(20, 0)), ("key", pa.binary()), ("payload", pa.binary()),
    ]
)
KINDS = pa.array([RECORD_TYPES.get(k) for k in range(max(RECORD_TYPES) + 1)])
FRAME_ARROW = pa.schema([*LOG_ARROW, ("status", pa.string()), ("available", pa.int64()), ("needed", pa.int64())])


@dataclass
class SegmentPart(InputPartition):
    segment: int
    path: str
    is_last: bool
    start: int = 0
    end: int | None = None


@dataclass
class SharedPart(InputPartition):
    """Neighbouring segments that one task reads, in their order."""

    parts: list[SegmentPart]


def shared(parts: list[SegmentPart], sizes: list[int]) -> list[SharedPart]:
    """At least one, so that an empty store has a plan."""
    most = min(MOST_BYTES, max(LEAST_BYTES, sum(sizes) // SHARES))
    out, held = [SharedPart([])], 0
    for p, size in zip(parts, sizes):
        if held and held + size + FILE_BYTES > most:
            out.append(SharedPart([]))
            held = 0
        out[-1].parts.append(p)
        held += size + FILE_BYTES
    return out


def segment_batches(uri: str, part: SegmentPart, frames: bool, verify: bool, payload: bool, whole: bool = True) -> Iterator[pa.RecordBatch]:
    """A segment's rows. A torn tail of the last segment ends it; other damage
    raises, unless frames are asked for: then it is a row of its own."""
    data = fs.read_bytes(uri, part.path)[: part.end]
    found = decode_columns(data, part.start, verify)
    schema = FRAME_ARROW if frames else LOG_ARROW
    sizes = found.sizes
    for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes + 64) // BATCH_BYTES)) + 1) if whole and len(sizes) else ():
        starts, heads, n = found.starts[some], found.heads[some], len(some)
        key_at, key_len = starts + HEADER_BYTES, heads["key_len"].astype(np.int64)
        txids = np.zeros((n, 2), "<u8")  # a decimal is a number of 128 bits
        txids[:, 0] = heads["txid"]
        columns = [
            pa.array(np.full(n, part.segment)), pa.array(starts), pa.array(sizes[some]), KINDS.take(pa.array(heads["kind"])),
            pa.Array.from_buffers(pa.decimal128(20, 0), n, [None, pa.py_buffer(txids)]), strings_at(data, key_at, key_len),
            strings_at(data, key_at + key_len, heads["payload_len"].astype(np.int64)) if payload else pa.nulls(n, pa.binary()),
        ]
        if frames:
            columns += [pa.repeat(OK, n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    if found.status != OK:
        if frames:
            row = (part.segment, found.offset, found.available, None, None, None, None, found.status, found.available, found.needed)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
        elif not (part.is_last and found.status in (TRUNCATED, CRC_MISMATCH)):
            raise LogError(f"{found.status} at offset {found.offset} of segment {part.segment}")


def _truth(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise LogError(f"true or false, not {text!r}")
    return text.lower() == "true"


class LogReaderSource(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise LogError("option path is missing")
        self.uri, self.mode = options["path"], options.get("mode", "strict")
        if self.mode not in ("strict", "lazy", "frames"):
            raise LogError(f"unknown mode {self.mode!r}")
        self.verify, self.payload = _truth(options.get("verify_crc", "true")), _truth(options.get("payload", "true"))
        self.whole = _truth(options.get("whole", "true"))
        self.only = [int(x) for x in options["segments"].split(",") if x] if "segments" in options else None
        since = (x.split(":") for x in options.get("since", "").split(",") if x)
        self.since = {int(n): int(at) for n, at in since}
        self.low, self.high = int(options.get("from_segment", 0)), int(options.get("to_segment", 1 << 62))

    def partitions(self) -> list[SharedPart]:
        found = fs.list_segments(self.uri)
        if self.only is not None:
            there = {n: (n, p, s) for n, p, s in found}
            missing = [n for n in self.only if n not in there]
            if missing:
                raise LogError(f"segments are gone: {missing}")
            found = [there[n] for n in sorted(self.only)]
        last = found[-1][0] if found else None
        if self.mode != "strict":
            found = [x for x in found if self.low <= x[0] <= self.high]
        return shared([SegmentPart(n, p, n == last, self.since.get(n, 0)) for n, p, _ in found], [size for _, _, size in found])

    def read(self, partition: SharedPart) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from segment_batches(self.uri, part, self.mode == "frames", self.verify, self.payload, self.whole)


class LogStream(DataSourceStreamReader):
    """Micro-batches of the frames that were whole at their planning. A torn
    tail is "not yet": the next batch begins there again."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.most = int(options["max_bytes_per_trigger"]) if "max_bytes_per_trigger" in options else None
        self.ends: dict[int, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where whole frames end now, by headers alone; tasks check what they
        read. Only the very last frame is checked here, since a torn one may
        have all its bytes."""
        files, _ = fs.filesystem(self.uri)
        found = fs.list_segments(self.uri)
        left = self.most
        for k, (n, path, size) in enumerate(found):
            start, is_last = self.ends.get(n, 0), k == len(found) - 1
            if size > start and (left is None or left > 0):
                with files.open_input_file(path) as f:
                    got = hop(f, start, size, left)
                    if is_last and got.frames and not frame_is_whole(f, got.last, got.offset):
                        got.status, got.offset = CRC_MISMATCH, got.last
                if got.status != OK and (not is_last or got.status not in (TRUNCATED, CRC_MISMATCH)):
                    raise LogError(f"{got.status} at offset {got.offset} of segment {n}")
                self.ends[n] = got.offset
                left = None if left is None else left - (got.offset - start)
            else:
                self.ends.setdefault(n, 0)
        return {str(n): at for n, at in sorted(self.ends.items())}

    def partitions(self, start: dict, end: dict) -> list[SharedPart]:
        files = {n: p for n, p, _ in fs.list_segments(self.uri)}
        for n, at in end.items():
            self.ends[int(n)] = max(self.ends.get(int(n), 0), at)
        parts = [
            SegmentPart(int(n), files[int(n)], False, start.get(n, 0), at) for n, at in end.items() if at > start.get(n, 0)
        ]
        return shared(parts, [p.end for p in parts])

    def read(self, partition: SharedPart) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from segment_batches(self.uri, part, False, True, True)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    task: int
    file: str
    records: int
    low: int
    high: int
    made: list[tuple[int, str]] = field(default_factory=list)  # segments and their files, where rows tell the segment


def frame_is_whole(f, at: int, end: int) -> bool:
    f.seek(at)
    return decode_segment(f.read(end - at)).status == OK


def last_txid(uri: str) -> int:
    """The last number of a store, from the headers of its last segment that has frames."""
    files, base = fs.filesystem(uri)
    if files.get_file_info(base).type.name == "NotFound":
        return 0
    found = fs.list_segments(uri)
    for k, (_, path, size) in enumerate(reversed(found)):
        with files.open_input_file(path) as f:
            got = hop(f, 0, size)
            if k == 0 and (got.status == TRUNCATED or got.frames and not frame_is_whole(f, got.last, got.offset)):
                raise LogError("the last segment has a torn tail; compact the store to a new one")
        if got.status != OK:
            raise LogError(f"{got.status} at offset {got.offset} of {path}")
        if got.frames:
            return got.txid
    return 0


class LogWriter(DataSourceArrowWriter):
    """A task's frames get their last numbers as they are written and its files
    are synced there, so commit() renames files and reads none. Numbers are the column txid (ascending over
    tasks, from 1, behind the store's last one) or, by the option bases, a
    task's number of rows before it and its own. Without either a task can't
    know, and commit() renumbers all but the first file."""

    def __init__(self, options: dict[str, str], overwrite: bool, numbered: bool = False, told: bool = False):
        self.uri, self.overwrite, self.numbered, self.told = options["path"], overwrite, numbered, told
        self.folder = f".staging-{uuid.uuid4().hex}"
        self.bases = {int(k): v for k, v in json.loads(options["bases"]).items()} if "bases" in options else None
        self.behind = last_txid(self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, base = fs.filesystem(self.uri)
        files.create_dir(f"{base}/{self.folder}", recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        before, told = self.bases.get(task, (0, 0)) if self.bases is not None else (0, None)
        name, n, low, high = f"{base}/{self.folder}/{task:08d}-{attempt}", 0, 0, self.behind
        made, out = [] if self.told else [(0, name)], None if self.told else files.open_output_stream(name)
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
                first = self.behind + before + n + 1
                numbers = _numbers(column("txid"), self.behind) if self.numbered else np.arange(first, first + b.num_rows, dtype=np.uint64)
                if int(numbers[0]) <= high or (numbers[1:] <= numbers[:-1]).any():
                    raise LogError("numbers must ascend")
                low, high = low or int(numbers[0]), int(numbers[-1])
                data, ends = encode_columns(column("record_type"), numbers, column("key"), column("payload"))
                n += b.num_rows
                segments = _numbers(column("segment"), 0) if self.told else np.zeros(b.num_rows, np.uint64)
                cuts, begin = [*(np.flatnonzero(np.diff(segments)) + 1), b.num_rows], 0
                for cut in cuts:
                    segment, end = int(segments[cut - 1]), int(ends[cut - 1])
                    if self.told and (not made or made[-1][0] != segment):
                        if segment <= (made[-1][0] if made else 0):
                            raise LogError("segments must ascend from 1")
                        if out:
                            out.close()
                        made.append((segment, f"{name}-{segment}"))
                        out = files.open_output_stream(made[-1][1])
                    out.write(pa.py_buffer(data[begin:end]))
                    begin = end
        finally:
            if out:
                out.close()
        if told is not None and n != told:
            raise LogError("the rows were dealt otherwise than when they were counted")
        if files.type_name == "local":
            for _, path in made:
                _sync(path)
        return Written(task, name, n, low, high, made if self.told else [])

    def commit(self, messages: list[Written | None]) -> None:
        from .store import DirLock, sync_dir

        files, base = fs.filesystem(self.uri)
        local = files.type_name == "local"
        lock = DirLock(base) if local else None
        try:
            if last_txid(self.uri) != self.behind:
                raise LogError("the store was written to since this job began")
            number, high, made = fs.next_segment([n for n, _, _ in fs.list_segments(self.uri)]), self.behind, []
            whole = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.task)
            known = self.numbered or self.bases is not None
            if known:
                for m in whole:
                    if m.low <= high:
                        raise LogError("numbers must ascend over tasks")
                    high = m.high
            named = [(number - 1 + segment, file) for m in whole for segment, file in m.made]
            if any(b[0] <= a[0] for a, b in zip(named, named[1:])):
                raise LogError("segments must ascend over tasks")
            for segment, file in named:
                files.move(file, f"{base}/{fs.segment_name(segment)}")
            for m in whole if not self.told else ():
                target = f"{base}/{fs.segment_name(number)}"
                if known or high == self.behind:
                    files.move(m.file, target)
                else:
                    _renumber(files, m.file, target, high - self.behind)
                    made.append(target)
                if not known:
                    high += m.records
                number += 1
            self.abort(messages)
            if local:
                for path in made:
                    _sync(path)
                sync_dir(base)
        finally:
            if lock:
                lock.release()

    def abort(self, messages: list[Written | None]) -> None:
        files, base = fs.filesystem(self.uri)
        if files.get_file_info(f"{base}/{self.folder}").type.name == "Directory":
            files.delete_dir(f"{base}/{self.folder}")


def _sync(path: str) -> None:
    with open(path, "rb") as f:
        os.fsync(f.fileno())


def _numbers(column: pa.Array, behind: int) -> np.ndarray:
    """behind + each, in 64 bits without sign."""
    if column.null_count:
        raise LogError("numbers must not be null")
    if pa.types.is_integer(column.type):
        got = column.to_numpy(zero_copy_only=False)
        if len(got) and 0 <= got.min() and int(got.max()) + behind < 1 << 64:
            return got.astype(np.uint64) + np.uint64(behind)
    got = [behind + int(x) for x in column.to_pylist()]
    if not all(0 <= x < 1 << 64 for x in got):
        raise LogError("numbers have 64 bits")
    return np.array(got, np.uint64)


def _renumber(files, source: str, target: str, add: int) -> None:
    with files.open_input_file(source) as f:
        data = f.read()
    rows = []
    for fr in decode_segment(data, verify_crc=False).frames:
        a = fr.key_at + fr.key_len
        rows.append((fr.record_type, fr.txid + add, data[fr.key_at : a], data[a : a + fr.payload_len]))
    with files.open_output_stream(target + ".part") as out:
        out.write(b"".join(encode_frames(rows)))
    files.move(target + ".part", target)
    files.delete_file(source)


class FramedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framedlog"

    def schema(self) -> StructType:
        return FRAME_SCHEMA if self.options.get("mode") == "frames" else LOG_SCHEMA

    def reader(self, schema: StructType) -> LogReaderSource:
        return LogReaderSource(dict(self.options))

    def streamReader(self, schema: StructType) -> LogStream:
        return LogStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        missing = {"record_type", "key", "payload"}.difference(schema.names)
        if missing:
            raise LogError(f"columns are missing: {sorted(missing)}")
        if overwrite:
            raise LogError("a log is only appended to")
        if "segment" in schema.names and not ("txid" in schema.names or "bases" in self.options):
            raise LogError("rows that tell their segment need numbers")
        return LogWriter(dict(self.options), overwrite, "txid" in schema.names, "segment" in schema.names)


def register(spark) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(FramedLog)


def read_log(spark, path: str, mode: str = "strict", **options: str):
    """A store as a DataFrame with a frozen list of segments. Strict mode looks
    at every segment first, as opening a store does."""
    from ..operators.log import check_frames

    register(spark)
    frozen = [n for n, _, _ in fs.list_segments(path)]
    fixed = {"path": path, "segments": ",".join(map(str, frozen))}

    def load(**more: str):  # a reader keeps the options it is given, so each load has its own
        return spark.read.format("framedlog").options(**fixed, **more).load()

    if mode == "strict":
        check_frames(load(mode="frames", payload="false", whole="false"), frozen[-1] if frozen else None)
    return load(mode="frames" if mode == "frames" else "lazy", **options)


def segment_digests(spark, path: str):
    """name, bytes and sha256 of each segment file, by name; files are hashed
    as they stream, one task for some of them."""
    import hashlib

    found = [(fs.segment_name(n), p, s) for n, p, s in fs.list_segments(path)]
    schema = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.filesystem(path)
        for b in it:
            rows = []
            for name, at, size in zip(*(b.column(k).to_pylist() for k in range(3))):
                h = hashlib.sha256()
                with files.open_input_stream(at) as f:
                    while chunk := f.read(BATCH_BYTES):
                        h.update(chunk)
                rows.append((name, size, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    listed = spark.createDataFrame(found, "name string, path string, bytes long")
    return listed.mapInArrow(run, "name string, bytes long, sha256 string").orderBy("name")
