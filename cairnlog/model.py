"""The data model: frames, their columns and limits."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType, DecimalType, LongType, StringType, StructField, StructType,
)

# Fixed values of the binary format.
MAGIC = b"DWAL"
VERSION = 1
SUFFIX = ".dwal"
HEADER_BYTES = 24
TRAILER_BYTES = 4
MOST_KEY_BYTES = 64 * 1024
MOST_PAYLOAD_BYTES = 64 * 1024 * 1024
RECORD_TYPES = {0: "Raw", 1: "Put", 2: "Delete"}

#: Bytes of a frame besides key and payload.
OVERHEAD = HEADER_BYTES + TRAILER_BYTES
TYPE_BYTES = {name: byte for byte, name in RECORD_TYPES.items()}
LARGEST_SEGMENT = 99_999_999

#: Unsigned 32-bit numbers are LONG; the 64-bit number of an append is DECIMAL(20,0).
LOG_SCHEMA = StructType(
    [
        StructField("segment", LongType(), False), StructField("offset", LongType(), False),
        StructField("len", LongType(), False), StructField("record_type", StringType()),
        StructField("txid", DecimalType(20, 0)), StructField("key", BinaryType()), StructField("payload", BinaryType()),
    ]
)

#: One row for each frame, status ok, and one for what ends a segment early.
FRAME_SCHEMA = StructType(
    [
        *LOG_SCHEMA.fields, StructField("status", StringType(), False),
        StructField("available", LongType()), StructField("needed", LongType()),
    ]
)

OK, TRUNCATED, CRC_MISMATCH = "ok", "truncated", "crc_mismatch"
#: Errors that no segment may have, not even the last one.
STRUCTURAL = ("bad_magic", "bad_version", "bad_type", "bad_flags", "key_too_large", "payload_too_large")


class LogError(Exception):
    """A log that can't be read or written as asked."""
