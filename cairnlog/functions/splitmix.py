"""SplitMix64: reproducible bytes for fixtures, in numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Seeds and shapes of the soak streams: rows, key bytes, payload bytes.
SOAK = {"small": (0x5050505000000001, 100, 32, 512), "medium": (0x5050505000000002, 100, 32, 3072), "large": (0x5050505000000003, 20, 32, 65536)}


def words(seed: int, n: int, after: int = 0) -> np.ndarray:
    """The numbers after+1 ... after+n of the sequence, all at once."""
    z = np.uint64(seed) + np.arange(after + 1, after + n + 1, dtype=np.uint64) * np.uint64(STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def stream(seed: int, rows: int, key: int, payload: int) -> list[tuple[bytes, bytes]]:
    """Keys and payloads, one after the other from one sequence; sizes are whole words."""
    per = (key + payload) // 8
    data = words(seed, rows * per).astype("<u8").tobytes()
    size = key + payload
    return [(data[i * size : i * size + key], data[i * size + key : (i + 1) * size]) for i in range(rows)]
