import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlog.functions.crc32c import _short, crc32c, crc32c_many
from cairnlog.model import MOST_KEY_BYTES, MOST_PAYLOAD_BYTES, OK, LogError
from cairnlog.sources import fs
from cairnlog.sources.codec import decode_segment, encode_frame, encode_frames

GOLDEN = [
    (("Raw", 1, b"", b"alpha"), "4457414c0100000001000000000000000000000005000000616c70686159e778f6"),
    (("Put", 1, b"alpha", b"1"), "4457414c0100010001000000000000000500000001000000616c70686131bd214021"),
    (("Delete", 4, b"beta", b""), "4457414c010002000400000000000000040000000000000062657461de5ce364"),
]


@pytest.mark.parametrize("data, want", [(b"", 0), (b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA)])
def test_crc_vectors(data, want):
    assert crc32c(data) == want
    assert crc32c(b"123456789") != 0xCBF43926


@given(st.lists(st.binary(max_size=700), max_size=12))
@settings(max_examples=40, deadline=None)
def test_crc_of_many_is_that_of_each(parts):
    lengths = np.array([len(p) for p in parts], np.int64)
    got = crc32c_many(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [_short(p) for p in parts]


@pytest.mark.parametrize("record, want", GOLDEN)
def test_golden_frames(record, want):
    assert encode_frame(*record).hex() == want
    assert encode_frames([record])[0].hex() == want


records = st.tuples(st.sampled_from(["Raw", "Put", "Delete"]), st.integers(0, 2**64 - 1), st.binary(max_size=40), st.binary(max_size=300))


@given(st.lists(records, max_size=20))
@settings(max_examples=50, deadline=None)
def test_round_trip(rows):
    data = b"".join(encode_frame(*r) for r in rows)
    found = decode_segment(data)
    assert found.status == OK and found.offset == len(data)
    got = [(f.record_type, f.txid, data[f.key_at :][: f.key_len], data[f.key_at + f.key_len :][: f.payload_len]) for f in found.frames]
    assert got == rows


@given(st.binary(max_size=400))
@settings(max_examples=100, deadline=None)
def test_decoder_is_total(data):
    found = decode_segment(data)
    assert sum(f.len for f in found.frames) == found.offset and found.available == len(data) - found.offset


def damaged(at, value):
    data = bytearray(encode_frame("Put", 1, b"k", b"value"))
    data[at : at + len(value)] = value
    return bytes(data)


@pytest.mark.parametrize(
    "data, status",
    [
        (damaged(0, b"X"), "bad_magic"), (damaged(4, b"\xca\xfe"), "bad_version"), (damaged(6, b"\3"), "bad_type"),
        (damaged(7, b"\1"), "bad_flags"), (damaged(16, struct.pack("<I", MOST_KEY_BYTES + 1)), "key_too_large"),
        (damaged(20, struct.pack("<I", MOST_PAYLOAD_BYTES + 1)), "payload_too_large"), (damaged(26, b"?"), "crc_mismatch"),
        (damaged(0, b"")[:-1], "truncated"), (bytes(23), "truncated"), (bytes(24), "bad_magic"),
    ],
)
def test_damage(data, status):
    good = encode_frame("Raw", 1, b"", b"good")
    found = decode_segment(good + data)
    assert found.status == status and found.offset == len(good) and len(found.frames) == 1


def test_checksum_damage_comes_before_later_structural_damage():
    bad = damaged(26, b"?")
    found = decode_segment(bad + bytes(30))
    assert (found.status, found.offset, found.frames) == ("crc_mismatch", 0, [])


def test_limits():
    assert len(encode_frame("Put", 1, b"k" * MOST_KEY_BYTES, b"")) == 28 + MOST_KEY_BYTES
    with pytest.raises(LogError):
        encode_frame("Put", 1, b"k" * (MOST_KEY_BYTES + 1), b"")
    with pytest.raises(LogError):
        encode_frame("Put", 1, b"", b"p" * (MOST_PAYLOAD_BYTES + 1))
    with pytest.raises(LogError):
        encode_frame("Other", 1, b"", b"")


@pytest.mark.parametrize("name, want", [("00000001.dwal", 1), ("99999999.dwal", 99999999), ("1.dwal", None), ("000000001.dwal", None), ("00000001.log", None), ("0000000a.dwal", None)])
def test_segment_names(name, want):
    assert fs.parse_segment_name(name) == want


def test_segment_numbers(tmp_path):
    assert fs.segment_name(7) == "00000007.dwal"
    with pytest.raises(LogError):
        fs.segment_name(100_000_000)
    for n in (3, 1):
        (tmp_path / fs.segment_name(n)).write_bytes(b"")
    (tmp_path / "00000002.dwal").mkdir()
    (tmp_path / "notes").write_text("x")
    assert [n for n, _, _ in fs.list_segments(str(tmp_path))] == [1, 3]
    assert fs.next_segment([]) == 1 and fs.next_segment([1, 3]) == 4
    with pytest.raises(LogError):
        fs.list_segments(str(tmp_path / "none"))
    with pytest.raises(LogError):
        fs.list_segments(str(tmp_path / "notes"))


def test_single_checksums_are_those_of_many():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 127, 128, 129, 300, 4095, 4096, 4097, 9000):
        data = r.integers(0, 256, n).astype(np.uint8)
        assert crc32c(data.tobytes()) == int(crc32c_many(data, np.array([0]), np.array([n]))[0])
