"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by
integral images, written as NPY tiles with difference hashes.

Every operator works row by row, so nothing is shuffled; a file that can't be
decoded gives null columns and its error, never a failed task. Null media:
null columns. Samples of up to 8 bits; anything deeper is an error row. Texts
as media: null and empty ones are 64 zero bytes, very long ones are whole
images, repeated rows and ids are rows of their own, other columns aren't read,
and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, documents, id_and_text, stream

#: Samples in a row of the stored image of a text; the payload is padded to it.
WIDTH = 64
TILE = 32

_HEAD = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
_MAX = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with at most 255 as the largest sample: (rows, columns) or
    (rows, columns, 3), unsigned 8 bit from 0 to 255. A bit of 1 is black, and
    samples with another largest one are scaled to 255."""
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not a Netpbm file")
    kind, width, height = int(m[1]), int(m[2]), int(m[3])
    at = m.end()
    most = 1
    if kind not in (1, 4):
        m = _MAX.match(data, at)
        if not m or not 0 < int(m[1]) < 256:
            raise ValueError("largest sample is missing or over 255")
        at, most = m.end(), int(m[1])
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if kind == 4:
        per = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, per * height, at + 1).reshape(height, per)
        return 255 * (1 - np.unpackbits(raw, axis=1)[:, :width])
    if kind in (5, 6):
        return _scaled(np.frombuffer(data, np.uint8, n, at + 1), most).reshape(shape)
    body = re.sub(rb"#[^\n]*", b"", data[at:])
    parts = re.findall(rb"[01]", body) if kind == 1 else body.split()
    if len(parts) < n:
        raise ValueError("samples are missing")
    samples = np.array([int(x) for x in parts[:n]], object)
    if n and not 0 <= samples.min() <= samples.max() <= most:
        raise ValueError("a sample is out of range")
    samples = samples.astype(np.uint8)
    return (255 * (1 - samples) if kind == 1 else _scaled(samples, most)).reshape(shape)


def _scaled(samples: np.ndarray, most: int) -> np.ndarray:
    if most == 255:
        return samples
    if samples.size and samples.max() > most:
        raise ValueError("a sample is out of range")
    return ((samples.astype(np.int64) * 510 + most) // (2 * most)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bit with a palette, or 24 or 32 bit. A grey
    palette gives (rows, columns), anything else (rows, columns, 3) as RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    begin, head, width, height, planes, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    if bits not in (8, 24, 32) or packed or planes != 1 or width <= 0:
        raise ValueError(f"BMP of {bits} bits, compression {packed}, isn't supported")
    rows, per = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * per, begin).reshape(rows, per)[:, : width * bits // 8]
    if height > 0:
        raw = raw[::-1]
    if bits != 8:
        return raw.reshape(rows, width, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + head).reshape(-1, 4)[:, 2::-1]
    if len(palette) < 256:
        palette = np.vstack([palette, np.zeros((256 - len(palette), 3), np.uint8)])
    if (palette == palette[:, :1]).all():
        return palette[:, 0][raw]
    return palette[raw]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, rows from the bottom."""
    rows, width = image.shape
    per = (width + 3) // 4 * 4
    body = np.zeros((rows, per), np.uint8)
    body[:, :width] = image[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    grey[:, 3] = 0
    begin = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", begin + body.size, 0, 0, begin)
    head += struct.pack("<IiiHHIIiiII", 40, width, rows, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    return head + grey.tobytes() + body.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """(rows, columns) of 0 to 255; colours by their luma in whole numbers."""
    if image.ndim == 2:
        return image
    x = image.astype(np.int64)
    return ((299 * x[..., 0] + 587 * x[..., 1] + 114 * x[..., 2] + 500) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Each target pixel is the mean over its area of the source, parts of
    pixels counted by their share, read from one integral image."""
    h, w = image.shape
    if not h or not w:
        return np.zeros((rows, columns))
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def along(values: np.ndarray, n: int, source: int) -> np.ndarray:
        at = np.arange(n + 1) * (source / n)
        low = np.minimum(at.astype(np.int64), source - 1)
        part = (at - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] * (1 - part) + values[low + 1] * part

    cut = along(along(total, rows, h).T, columns, w).T
    return np.diff(np.diff(cut, axis=0), axis=1) / ((h / rows) * (w / columns))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: is a pixel of the 8 x 9 thumbnail darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image, area-resized to a square, as an NPY file."""
    small = np.floor(area_resize(image, side, side) + 0.5).clip(0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, small, allow_pickle=False)
    return out.getvalue()


FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("samples", pa.binary()),
        ("tile_npy", pa.binary()), ("dhash", pa.string()), ("error", pa.string()),
    ]
)
FEATURES_DDL = "doc_id long, height long, width long, samples binary, tile_npy binary, dhash string, error string"


def features(media: DataFrame, side: int = TILE) -> DataFrame:
    """From doc_id and media (binary): the decoded grey samples, the tile and the hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, data in stream(it, "doc_id", "media"):
                try:
                    if data is None:
                        raise ValueError("null")
                    x = grey(decode(data))
                    yield doc_id, *x.shape, x.tobytes(), tile(x, side), difference_hash(x), None
                except Exception as e:  # whatever a broken file leads to is its own row's error
                    yield doc_id, None, None, None, None, None, f"{type(e).__name__}: {e}"

        yield from batches(rows(), FEATURES, lambda r: 1500 + len(r[3] or b""))

    return media.select("doc_id", "media").mapInArrow(run, FEATURES_DDL)


def payload(text: str) -> bytes:
    """UTF-8, then zero bytes up to a positive multiple of the width."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def as_image(data: bytes) -> bytes:
    """The payload as an image of the width: an odd number of rows as PGM, an even one as BMP."""
    image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(image) if len(image) % 2 else encode_bmp(image)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as an image; null and empty
    texts are 64 zero bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in stream(it, "doc_id", "text"):
                yield doc_id, len(text.encode("utf-8", "surrogatepass")), as_image(payload(text))

        yield from batches(rows(), STORED, lambda r: 64 + len(r[2]))

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_sha256", pa.string()),
    ]
)


def digest(stored: DataFrame, side: int = TILE) -> DataFrame:
    """Decode the stored bytes of text_media and give digests of what was read back."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, n_bytes, media in stream(it, "doc_id", "n_bytes", "media"):
                x = grey(decode(media))
                data = x.tobytes()
                yield (
                    doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]),
                    len(media), hashlib.sha256(media).hexdigest(), difference_hash(x),
                    hashlib.sha256(tile(x, side)).hexdigest(),
                )

        yield from batches(rows(), DIGEST, lambda r: 400)

    ddl = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    )
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(text_media(documents(spark, sf_dir)))
