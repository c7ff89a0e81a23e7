"""Golomb codes of sorted 64-bit values, and the exchange of such lists with
the owners of ranges of values.

A list is its count, the length of its unary part and the parameter's bits,
then the gaps' quotients in unary and their remainders. The parameter is a
power of two of whole bytes near the mean gap, so remainders are plain bytes.
"""

from __future__ import annotations

import numpy as np


def parameter_bits(mean: int) -> int:
    """Of the two whole bytes around the best parameter, the one with shorter codes."""
    low = max(0, min(56, (max(1, mean).bit_length() - 1) // 8 * 8))
    return min((low, min(64, low + 8)), key=lambda b: b + mean / 2.0**b)


def encode(values: np.ndarray) -> bytes:
    """Ascending distinct unsigned 64-bit values."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    bits = parameter_bits(int(values[-1]) // n)
    quotient = (gaps >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
    unary = np.ones(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    rest = gaps.astype("<u8").view(np.uint8).reshape(n, 8)[:, : bits // 8]
    head = np.array([n, len(unary)], "<u8").tobytes() + bytes([bits])
    return head + np.packbits(unary).tobytes() + rest.tobytes()


def decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, length = (int(x) for x in np.frombuffer(data, "<u8", 2))
    bits, at = data[16], 17 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(data[17:at], np.uint8), count=length)
    quotient = (np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1).astype(np.uint64)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, : bits // 8] = np.frombuffer(data[at:], np.uint8).reshape(n, bits // 8)
    gaps = rest.view("<u8").ravel().astype(np.uint64)
    if bits < 64:
        gaps = gaps + (quotient << np.uint64(bits))
    return np.cumsum(gaps, dtype=np.uint64)


def starts(owners: int) -> np.ndarray:
    """The first value of each owner's range."""
    return np.array([(k << 64) // owners for k in range(owners)], np.uint64)


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
