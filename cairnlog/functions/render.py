"""Bytes for people: literal text where it is printable, else a marked encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .encoding import base64_of, hex_of

#: Source bytes that are shown.
SHOWN = 64
MODES = ("auto", "raw", "base64", "hex")


def is_printable(value: Column) -> Column:
    """Every byte is a tab or from space to tilde; empty is printable."""
    return F.hex(value).rlike("^(09|[2-6][0-9A-F]|7[0-9A-E])*$")


def cut(value: Column, shown: int | None = SHOWN) -> Column:
    return value if shown is None else F.substring(value, 1, shown)


def _dots(value: Column, shown: int | None) -> Column:
    return F.lit("") if shown is None else F.when(F.octet_length(value) > shown, "...").otherwise("")


def literal(value: Column, shown: int | None = SHOWN) -> Column:
    """The text; in quotes, with escapes, where a blank, tab, quote or
    backslash or nothing at all would blur it."""
    text = F.decode(cut(value, shown), "UTF-8")
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when((text == "") | text.rlike('[ \t"\\\\]'), quoted).otherwise(text)


def render(value: Column, mode: str = "auto", shown: int | None = SHOWN) -> Column:
    """A field of a line. auto and raw: literal if printable, else base64."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    b64 = F.concat(F.lit("b64:"), base64_of(cut(value, shown)))
    if mode == "hex":
        body = F.concat(F.lit("hex:"), hex_of(cut(value, shown)))
    elif mode == "base64":
        body = b64
    else:
        body = F.when(is_printable(value), literal(value, shown)).otherwise(b64)
    return F.concat(body, _dots(value, shown))


def render_value(value: Column, mode: str = "auto", shown: int | None = SHOWN) -> Column:
    """A looked-up value: struct of text, or of a hint where it would be binary."""
    none = F.lit(None).cast("string")
    if mode in ("auto", "raw"):
        good = is_printable(value)
        hint = F.concat(F.lit("<binary value, "), F.octet_length(value).cast("string"), F.lit(" bytes; use --bytes base64 or --bytes hex>"))
        return F.struct(F.when(good, F.decode(cut(value, shown), "UTF-8")).alias("text"), F.when(~good, hint).alias("hint"))
    body = base64_of(cut(value, shown)) if mode == "base64" else hex_of(cut(value, shown))
    return F.struct(body.alias("text"), none.alias("hint"))


def short_type(record_type: Column) -> Column:
    return F.when(record_type == "Raw", "RAW").when(record_type == "Put", "PUT").otherwise("DEL")


def record_line(mode: str = "auto", shown: int | None = SHOWN) -> Column:
    return F.format_string(
        "seg=%08d off=%10d len=%8d type=%-3s txid=%10s key=%s payload=%s",
        F.col("segment"), F.col("offset"), F.col("len"), short_type(F.col("record_type")), F.col("txid").cast("string"),
        render(F.col("key"), mode, shown), render(F.col("payload"), mode, shown),
    )


def frame_line(mode: str = "auto", shown: int | None = SHOWN) -> Column:
    return F.format_string(
        "seg=%08d off=%10d len=%8d type=%-3s txid=%10s key=%s key_len=%d payload_len=%d",
        F.col("segment"), F.col("offset"), F.col("len"), short_type(F.col("record_type")), F.col("txid").cast("string"),
        render(F.col("key"), mode, shown), F.octet_length("key"), F.octet_length("payload"),
    )
