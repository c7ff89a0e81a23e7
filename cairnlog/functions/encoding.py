"""Text forms of bytes, as Column expressions and as strict decoders."""

from __future__ import annotations

import base64
import binascii
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_of(value: Column) -> Column:
    """Standard alphabet, padded, without the line breaks that Spark puts in."""
    return F.translate(F.base64(value), "\r\n", "")


def hex_of(value: Column) -> Column:
    return F.lower(F.hex(value))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def little_endian(value: Column, size: int) -> Column:
    """Hex of a whole number's lowest bytes, least significant first. Built
    from hex pairs: reverse() of a BINARY would go through text."""
    wide = F.lpad(F.hex(value), 16, "0")
    return F.concat(*(F.substring(wide, 15 - 2 * k, 2) for k in range(size)))


def decode_base64(text: str) -> bytes:
    """Strict: canonical padding, no blanks."""
    try:
        data = base64.b64decode(text.encode("ascii"), validate=True)
    except (binascii.Error, UnicodeEncodeError) as e:
        raise ValueError(f"invalid base64: {e}") from None
    if base64.b64encode(data).decode() != text:
        raise ValueError("invalid base64: not canonical")
    return data


def decode_hex(text: str) -> bytes:
    """Both cases, an even number of digits, no prefix."""
    if len(text) % 2:
        raise ValueError("invalid hex: odd length")
    if not re.fullmatch("[0-9A-Fa-f]*", text):
        raise ValueError("invalid hex: not a hex digit")
    return bytes.fromhex(text)


def fnv1a64(value: Column) -> Column:
    """FNV-1a of a BINARY as 16 hex digits. The product of the 64-bit prime
    2^40 + 435 is formed from 32-bit halves, since Spark's LONG would overflow."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.octet_length(value) - 1),
        lambda i: F.conv(F.substring(F.hex(value), 2 * i + 1, F.lit(2)), 16, 10).cast("long"),
    )
    mask = F.lit(0xFFFFFFFF)

    def step(acc: Column, byte: Column) -> Column:
        low = acc["low"].bitwiseXOR(byte)
        product = low * 435
        high = (acc["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(mask)
        return F.struct(high.alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    bytes_ = F.when(F.octet_length(value) > 0, pairs).otherwise(F.array().cast("array<long>"))
    done = F.aggregate(bytes_, start, step)
    word = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    return F.concat(word(done["high"]), word(done["low"]))
