"""Frames to bytes and back. Headers are hopped one by one, since a frame has
no sync mark; checksums are computed for all frames of a segment at once. Tasks
take columns in and out, so that no frame becomes a Python object."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.crc32c import crc32c, crc32c_many, spread
from ..model import (
    CRC_MISMATCH, HEADER_BYTES, MAGIC, MOST_KEY_BYTES, MOST_PAYLOAD_BYTES, OK, OVERHEAD, RECORD_TYPES,
    TRAILER_BYTES, TRUNCATED, TYPE_BYTES, VERSION, LogError,
)

HEADER = struct.Struct("<4sHBBQII")
#: The lengths in a header, where they stand, and the header as columns.
LENGTHS, LENGTHS_AT = struct.Struct("<II"), 16
COLUMNS = np.dtype([("magic", "<u4"), ("version", "<u2"), ("kind", "u1"), ("flags", "u1"), ("txid", "<u8"), ("key_len", "<u4"), ("payload_len", "<u4")])
MAGIC_NUMBER = int.from_bytes(MAGIC, "little")
KINDS = np.isin(np.arange(256), list(RECORD_TYPES))
#: Strings are copied by the places of their bytes up to this mean length and sum, else one by one.
MEAN, TOTAL = 256, 16 << 20


def encode_frame(record_type: str, txid: int, key: bytes, payload: bytes) -> bytes:
    """Limits are checked before anything is copied."""
    if record_type not in TYPE_BYTES:
        raise LogError(f"unknown record type {record_type!r}")
    if len(key) > MOST_KEY_BYTES:
        raise LogError(f"key of {len(key)} bytes; at most {MOST_KEY_BYTES}")
    if len(payload) > MOST_PAYLOAD_BYTES:
        raise LogError(f"payload of {len(payload)} bytes; at most {MOST_PAYLOAD_BYTES}")
    body = HEADER.pack(MAGIC, VERSION, TYPE_BYTES[record_type], 0, txid, len(key), len(payload)) + key + payload
    return body + struct.pack("<I", crc32c(body))


def encode_frames(records: list[tuple[str, int, bytes, bytes]]) -> list[bytes]:
    """Many frames, their checksums computed together."""
    bodies = []
    for record_type, txid, key, payload in records:
        if record_type not in TYPE_BYTES or len(key) > MOST_KEY_BYTES or len(payload) > MOST_PAYLOAD_BYTES:
            encode_frame(record_type, txid, key, payload)  # raises with the reason
        bodies.append(HEADER.pack(MAGIC, VERSION, TYPE_BYTES[record_type], 0, txid, len(key), len(payload)) + key + payload)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    sums = crc32c_many(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return [b + int(c).to_bytes(4, "little") for b, c in zip(bodies, sums)]


def _by_bytes(lengths: np.ndarray) -> bool:
    return int(lengths.sum()) <= min(MEAN * len(lengths), TOTAL)


def _strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a column; null is empty."""
    values = values.cast(pa.binary()).fill_null(b"")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at[:-1], np.diff(at)


def encode_columns(types: pa.Array, txids: np.ndarray, keys: pa.Array, payloads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The frames of all rows (one at least), one behind the other, and where each ends."""
    kinds = pc.index_in(types.cast(pa.string()), pa.array(list(TYPE_BYTES)))
    if kinds.null_count:
        raise LogError(f"unknown record type {types[pc.is_null(kinds).index(True).as_py()].as_py()!r}")
    (key_bytes, key_at, key_len), (payload_bytes, payload_at, payload_len) = _strings(keys), _strings(payloads)
    for what, lengths, most in (("key", key_len, MOST_KEY_BYTES), ("payload", payload_len, MOST_PAYLOAD_BYTES)):
        if lengths.max() > most:
            raise LogError(f"{what} of {lengths.max()} bytes; at most {most}")
    sizes = OVERHEAD + key_len + payload_len
    ends = np.cumsum(sizes)
    starts, out = ends - sizes, np.empty(ends[-1], np.uint8)
    heads = np.zeros(len(sizes), COLUMNS)
    heads["magic"], heads["version"], heads["kind"] = MAGIC_NUMBER, VERSION, np.array(list(TYPE_BYTES.values()), np.uint8)[kinds.to_numpy()]
    heads["txid"], heads["key_len"], heads["payload_len"] = txids, key_len, payload_len
    out[starts[:, None] + np.arange(HEADER_BYTES)] = heads.view(np.uint8).reshape(-1, HEADER_BYTES)
    key_to = starts + HEADER_BYTES
    for data, at, lengths, to in ((key_bytes, key_at, key_len, key_to), (payload_bytes, payload_at, payload_len, key_to + key_len)):
        if _by_bytes(lengths):
            out[spread(to, lengths)] = data[spread(at, lengths)]
        else:
            for a, n, b in zip(at.tolist(), lengths.tolist(), to.tolist()):
                out[b : b + n] = data[a : a + n]
    sums = crc32c_many(out, starts, sizes - TRAILER_BYTES)
    out[(ends - TRAILER_BYTES)[:, None] + np.arange(TRAILER_BYTES)] = sums.astype("<u4").view(np.uint8).reshape(-1, TRAILER_BYTES)
    return out, ends


@dataclass
class Frame:
    record_type: str
    txid: int
    offset: int
    len: int
    key_at: int
    key_len: int
    payload_len: int


@dataclass
class Decoded:
    """The good frames of a segment's bytes, and what ended it."""

    frames: list[Frame]
    status: str  # ok: at the end of the bytes
    offset: int  # where the good frames end
    available: int  # bytes from there on
    needed: int | None


def header_at(data: bytes, at: int, left: int | None = None) -> tuple[str, int | None, tuple | None]:
    """(status, bytes needed, header) at an offset; checks in the format's
    order. `left` tells how many bytes there are where data is a part of them."""
    left = len(data) - at if left is None else left
    if left < HEADER_BYTES:
        return TRUNCATED, HEADER_BYTES, None
    magic, version, kind, flags, txid, key_len, payload_len = h = HEADER.unpack_from(data, at)
    if magic != MAGIC:
        return "bad_magic", None, None
    if version != VERSION:
        return "bad_version", None, None
    if kind not in RECORD_TYPES:
        return "bad_type", None, None
    if flags:
        return "bad_flags", None, None
    if key_len > MOST_KEY_BYTES:
        return "key_too_large", None, None
    if payload_len > MOST_PAYLOAD_BYTES:
        return "payload_too_large", None, None
    total = HEADER_BYTES + key_len + payload_len + TRAILER_BYTES
    if left < total:
        return TRUNCATED, total, None
    return OK, total, h


def decode_segment(data: bytes, start: int = 0, verify_crc: bool = True) -> Decoded:
    frames, at, status, needed = [], start, OK, None
    while at < len(data):
        status, needed, h = header_at(data, at)
        if status != OK:
            break
        _, _, kind, _, txid, key_len, payload_len = h
        frames.append(Frame(RECORD_TYPES[kind], txid, at, needed, at + HEADER_BYTES, key_len, payload_len))
        at += needed
    if verify_crc and len(frames) == 1:
        # A read by position: one string, without laying out many.
        f = frames[0]
        end = f.offset + f.len - TRAILER_BYTES
        if crc32c(data[f.offset : end]) != int.from_bytes(data[end : end + TRAILER_BYTES], "little"):
            status, at, needed = CRC_MISMATCH, f.offset, f.len
            frames.clear()
    elif verify_crc and frames:
        raw = np.frombuffer(data, np.uint8)
        starts = np.array([f.offset for f in frames], np.int64)
        lengths = np.array([f.len - TRAILER_BYTES for f in frames], np.int64)
        sums = crc32c_many(raw, starts, lengths)
        tails = raw[(starts + lengths)[:, None] + np.arange(4)].astype(np.uint32)
        stored = tails @ (np.uint32(1) << np.arange(0, 32, 8, dtype=np.uint32))
        bad = np.flatnonzero(stored.astype(np.uint32) != sums)
        if len(bad):
            first = frames[int(bad[0])]
            del frames[int(bad[0]) :]
            status, at, needed = CRC_MISMATCH, first.offset, first.len
    if status == OK:
        needed = None
    return Decoded(frames, status, at, len(data) - at, needed)


@dataclass
class Columns:
    """The same as Decoded, its good frames as arrays."""

    starts: np.ndarray
    heads: np.ndarray  # of COLUMNS
    status: str
    offset: int
    available: int
    needed: int | None

    @property
    def sizes(self) -> np.ndarray:
        return OVERHEAD + self.heads["key_len"].astype(np.int64) + self.heads["payload_len"]


def decode_columns(data: bytes, start: int = 0, verify_crc: bool = True) -> Columns:
    """decode_segment without an object for each frame: lengths are hopped, then headers and checksums looked at together."""
    found, at, size, lengths = [], start, len(data), LENGTHS.unpack_from
    while at + HEADER_BYTES <= size:
        k, p = lengths(data, at + LENGTHS_AT)
        end = at + OVERHEAD + k + p
        if end > size:
            break
        found.append(at)
        at = end
    raw, starts = np.frombuffer(data, np.uint8), np.array(found, np.int64)
    heads = np.ascontiguousarray(raw[starts[:, None] + np.arange(HEADER_BYTES)]).view(COLUMNS).ravel() if found else np.empty(0, COLUMNS)
    good = (heads["magic"] == MAGIC_NUMBER) & (heads["version"] == VERSION) & KINDS[heads["kind"]] & (heads["flags"] == 0)
    good &= (heads["key_len"] <= MOST_KEY_BYTES) & (heads["payload_len"] <= MOST_PAYLOAD_BYTES)
    if not good.all():
        n = int(np.argmin(good))
        at, starts, heads = found[n], starts[:n], heads[:n]
    status, needed, _ = header_at(data, at) if at < size else (OK, None, None)
    got = Columns(starts, heads, status, at, size - at, needed)
    if verify_crc and len(starts):
        ends = starts + got.sizes - TRAILER_BYTES
        stored = np.ascontiguousarray(raw[ends[:, None] + np.arange(TRAILER_BYTES)]).view("<u4").ravel()
        bad = np.flatnonzero(stored != crc32c_many(raw, starts, ends - starts))
        if len(bad):
            n = int(bad[0])
            at, needed = found[n], int(got.sizes[n])
            got = Columns(starts[:n], heads[:n], CRC_MISMATCH, at, size - at, needed)
    return got


def strings_at(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Pieces of the bytes as a column."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    if _by_bytes(lengths):
        flat = pa.py_buffer(np.frombuffer(data, np.uint8)[spread(starts, lengths)])
    else:
        flat = pa.py_buffer(b"".join(data[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), flat])


@dataclass
class Hopped:
    """What headers alone tell of a segment from an offset on."""

    frames: int
    txid: int  # the last number, 0 without frames
    last: int  # where the last frame begins
    status: str
    offset: int  # where whole frames end


def hop(f, at: int, size: int, most: int | None = None, window: int = 1 << 16) -> Hopped:
    """Hop the headers of an open file by windows, payloads beyond them unread;
    at most about `most` bytes on. Checksums aren't looked at."""
    got, data, begin, stop = Hopped(0, 0, at, OK, at), b"", at, size if most is None else at + most
    while at < min(size, stop):
        if not begin <= at <= begin + len(data) - min(HEADER_BYTES, size - at):
            f.seek(at)
            data, begin = f.read(min(window, size - at)), at
        got.status, needed, h = header_at(data, at - begin, size - at)
        if got.status != OK:
            break
        got.frames, got.txid, got.last = got.frames + 1, h[4], at
        at += needed
    got.offset = at
    return got
