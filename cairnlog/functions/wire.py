"""The frame's header and size as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAGIC, OVERHEAD, TYPE_BYTES, VERSION
from .encoding import little_endian


def wire_size(key: Column, payload: Column) -> Column:
    return (F.lit(OVERHEAD) + F.octet_length(key) + F.octet_length(payload)).cast("long")


def type_byte(record_type: Column) -> Column:
    found = F.lit(None).cast("int")
    for name, byte in TYPE_BYTES.items():
        found = F.when(record_type == name, byte).otherwise(found)
    return found


def wire_header(record_type: Column, txid: Column, key: Column, payload: Column) -> Column:
    """The 24 bytes before the key, as upper-case hex."""
    return F.concat(
        F.lit(MAGIC.hex().upper()), little_endian(F.lit(VERSION).cast("long"), 2), F.lpad(F.hex(type_byte(record_type).cast("long")), 2, "0"),
        F.lit("00"), little_endian(txid.cast("long"), 8), little_endian(F.octet_length(key).cast("long"), 4),
        little_endian(F.octet_length(payload).cast("long"), 4),
    )
