"""CRC-32C (Castagnoli) of many byte strings at once, in numpy.

Spark has only the IEEE polynomial. The register is linear in the message when
it starts at zero, and leading zero bytes don't change it. So a message's
first four bytes are inverted (the same as starting at all ones), zeros go in
front to fill it up to a power of two of lanes, all lanes of all messages are
run together, and neighbouring lanes are joined by the operator that advances
a register over so many zero bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

POLYNOMIAL = 0x82F63B78  # bits reversed
LANE = 128
#: Bytes that are laid out as lanes at once.
CHUNK = 32 << 20
#: Longest single string that is summed by places, the longest of many, and the bytes of those at once.
PLACES, SHORT, AT_ONCE = 4096, 512, 1 << 18


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _table()


@lru_cache(maxsize=None)
def _advance(doublings: int) -> np.ndarray:
    """Tables (4, 256) of the operator over LANE * 2**doublings zero bytes."""
    if doublings == 0:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(LANE):
            columns = TABLE[columns & 0xFF] ^ (columns >> 8)
    else:
        half = _advance(doublings - 1)
        columns = _apply(half, _apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(np.arange(256) >> bit & 1, columns[8 * byte + bit], 0).astype(np.uint32)
    return out


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    return op[0][x & 0xFF] ^ op[1][x >> 8 & 0xFF] ^ op[2][x >> 16 & 0xFF] ^ op[3][x >> 24]


def _short(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = int(TABLE[(r ^ b) & 0xFF]) ^ (r >> 8)
    return r ^ 0xFFFFFFFF


def crc32c_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of data[start : start + length], unsigned 32 bit."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    out = np.zeros(len(starts), np.uint32)
    lanes = np.maximum(1, -(-lengths // LANE))
    doublings = np.ceil(np.log2(lanes)).astype(np.int64)
    for i in np.flatnonzero(lengths < 4):
        out[i] = _short(data[starts[i] : starts[i] + lengths[i]].tobytes())
    short = np.flatnonzero((lengths >= 4) & (lengths <= SHORT))
    for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // AT_ONCE)) + 1) if len(short) else ():
        out[some] = _by_places(data, starts[some], lengths[some])
    for d in np.unique(doublings[lengths > SHORT]):
        which = np.flatnonzero((doublings == d) & (lengths > SHORT))
        size = LANE << int(d)
        for at in range(0, len(which), max(1, CHUNK // size)):
            some = which[at : at + max(1, CHUNK // size)]
            grid = np.zeros((len(some), size), np.uint8)
            for row, i in enumerate(some):
                n = int(lengths[i])
                grid[row, size - n :] = data[starts[i] : starts[i] + n]
                grid[row, size - n : size - n + 4] ^= 0xFF
            steps = np.ascontiguousarray(grid.reshape(-1, LANE).T)
            r = np.zeros(steps.shape[1], np.uint32)
            for k in range(LANE):
                r = TABLE[(r ^ steps[k]) & 0xFF] ^ (r >> 8)
            for k in range(int(d)):
                r = r.reshape(-1, 2)
                r = _apply(_advance(k), r[:, 0]) ^ r[:, 1]
            out[some] = r ^ np.uint32(0xFFFFFFFF)
    return out


@lru_cache(maxsize=None)
def _places() -> np.ndarray:
    """(place, byte): what a byte adds to the register when so many bytes follow it."""
    out = np.empty((PLACES, 256), np.uint32)
    out[0] = TABLE
    for k in range(1, PLACES):
        out[k] = TABLE[out[k - 1] & 0xFF] ^ (out[k - 1] >> 8)
    return out.ravel()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of the bytes of all strings, one string behind the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _by_places(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of strings of 4 to PLACES bytes."""
    ends = np.cumsum(lengths)
    x = data[spread(starts, lengths)]
    x[((ends - lengths)[:, None] + np.arange(4)).ravel()] ^= 0xFF
    follow = np.repeat(ends - 1, lengths) - np.arange(len(x))
    return np.bitwise_xor.reduceat(_places()[follow * 256 + x], ends - lengths) ^ np.uint32(0xFFFFFFFF)


#: Where the row of each place begins, the last byte's first, in reading order.
_ROWS = np.arange(PLACES - 1, -1, -1) * 256


def crc32c(data: bytes) -> int:
    """Of one string: short ones by a sum over places, without the lanes."""
    n = len(data)
    if 4 <= n <= PLACES:
        x = np.frombuffer(data, np.uint8).astype(np.int64)
        x[:4] ^= 0xFF
        x += _ROWS[PLACES - n :]
        return int(np.bitwise_xor.reduce(_places()[x])) ^ 0xFFFFFFFF
    return int(crc32c_many(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


@F.pandas_udf(LongType())
def crc32c_column(values: pd.Series) -> pd.Series:
    """Checksums of a BINARY column; null of null."""
    there = values.dropna()
    lengths = np.fromiter(map(len, there), np.int64, len(there))
    data = np.frombuffer(b"".join(there), np.uint8)
    got = crc32c_many(data, np.cumsum(lengths) - lengths, lengths)
    return pd.Series(got.astype(np.int64), index=there.index).reindex(values.index).astype("Int64")
