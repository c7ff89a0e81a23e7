"""Token shards as sorted string tables.

Documents are dealt to shards by ranges of their id and sorted there. A shard
is written by one task, block by block:

    block   = zstd(entries); entry = varint shared, varint rest, rest of the
              key, varint bytes, ids as unsigned little-endian 16- or 32-bit
    index   = for each block: first key, place, size, crc32, documents and ids before it
    bloom   = bits over all keys
    footer  = places and sizes of index and bloom, documents, ids, id width, magic

The key is the id's 8 bytes, sign bit flipped, behind 0 for null or 1, so
bytes sort as ids do. Files appear under their names by a rename, so a task
that runs again leaves the same file. Rows of one id sort by text.
Null or empty text: the end id alone. Very long texts are one entry, in a
block of their own size. Other columns aren't read. Empty table: no shard, no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import batches, documents, filesystem, id_and_text, materialise, shared_dir, stream

END = 2
MAGIC = b"CRNSST02"
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQB7x8s")
ENTRY = struct.Struct("<QIIQQ")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    k = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return (hashes[:, None] + k * step[:, None]) % np.uint64(n_bits)


class Writer:
    """Writes one shard; add() in ascending order of key."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.packer = zstandard.ZstdCompressor(level=1)
        self.place = self.docs = self.ids = 0
        self.block, self.block_bytes, self.first, self.last = [], 0, b"", b""
        self.before = (0, 0)
        self.index: list[tuple] = []
        self.hashes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last, self.before = key, b"", (self.docs, self.ids)
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        body = ids.astype(f"<u{self.width}").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + key[shared:] + varint(len(body)) + body
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.last = key
        if not self.hashes or key != self.previous:
            self.hashes.append(xxhash.xxh3_64_intdigest(key))
        self.previous = key
        self.docs += 1
        self.ids += len(ids)
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.place
        self.out.write(data)
        self.place += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            data = self.packer.compress(b"".join(self.block))
            at, size = self._put(data)
            self.index.append((self.first, ENTRY.pack(at, size, zlib.crc32(data), *self.before)))
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + e for k, e in self.index)
        n_bits = max(64, BLOOM_BITS * len(self.hashes) + 7 & ~7)
        bits = np.zeros(n_bits, np.uint8)
        if self.hashes:
            bits[_bits(np.array(self.hashes, np.uint64), n_bits).ravel().astype(np.int64)] = 1
        a = self._put(index)
        b = self._put(np.packbits(bits).tobytes())
        self._put(FOOTER.pack(*a, *b, self.docs, self.ids, self.width, MAGIC))


class Reader:
    """Reads one shard; opened from a pyarrow input file."""

    def __init__(self, file):
        self.file = file
        self.unpacker = zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - FOOTER.size)
        ia, il, ba, bl, self.docs, self.ids, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at, self.index = self._at(ia, il), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.index.append((raw[at : at + n], *ENTRY.unpack_from(raw, at + n)))
            at += n + ENTRY.size
        self.bloom = np.unpackbits(np.frombuffer(self._at(ba, bl), np.uint8))

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size, crc, _, _ = self.index[i]
        data = self._at(place, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        raw, at, key = self.unpacker.decompress(data), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            n, at = read_varint(raw, at + rest)
            yield key, np.frombuffer(raw, f"<u{self.width}", n // self.width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document: its id, the ids of the shard before it, its ids."""
        for i, (*_, before) in enumerate(self.index):
            for key, ids in self.block(i):
                yield id_of(key), before, ids
                before += len(ids)

    def maybe(self, doc_id: int | None) -> bool:
        h = np.array([xxhash.xxh3_64_intdigest(key_of(doc_id))], np.uint64)
        return bool(self.bloom[_bits(h, len(self.bloom)).ravel().astype(np.int64)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of a document, by binary search over the index."""
        import bisect

        if not self.index or not self.maybe(doc_id):
            return []
        key = key_of(doc_id)
        firsts = [e[0] for e in self.index]
        out = []
        for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            out += [ids.copy() for k, ids in self.block(i) if k == key]
        return out


MANIFEST = pa.schema(
    [
        ("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()),
        ("first_id", pa.int64()), ("last_id", pa.int64()), ("bytes", pa.int64()),
    ]
)
MANIFEST_DDL = "shard long, path string, docs long, ids long, first_id long, last_id long, bytes long"


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end: int = END, width: int = 2) -> DataFrame:
    """Writes the shards and returns their manifest, a row for each shard."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        rows = bpe.together(stream(it, "doc_id", "text"))
        held = next(rows, None)
        if not held:
            return
        encode = bpe.encoder(vocabulary).ids
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/shard-{number:06d}.sst"
        first, last, last_id = held[0][0], None, int(end).to_bytes(4, "little")
        with files.open_output_stream(f"{name}.{attempt}") as out:
            w = Writer(out, width)
            while held:
                for (doc_id, _), raw in zip(held, encode([t for _, t in held])):
                    ids = np.frombuffer(raw + last_id, "<u4")
                    if width == 2 and ids.max() > 0xFFFF:
                        raise ValueError("ids over 65535 need width 4")
                    w.add(doc_id, ids)
                    last = doc_id
                held = next(rows, None)
            w.close()
        files.move(f"{name}.{attempt}", name)
        path = f"{folder.rstrip('/')}/shard-{number:06d}.sst"
        yield pa.RecordBatch.from_pylist(
            [dict(shard=number, path=path, docs=w.docs, ids=w.ids, first_id=first, last_id=last, bytes=w.place)],
            schema=MANIFEST,
        )

    dealt = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    made = dealt.select("doc_id", "text").mapInArrow(run, MANIFEST_DDL)
    return materialise(made, "manifest")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and tokens
    (little-endian unsigned 32-bit), from the files. The manifest has a row
    for each shard, so its running sum is over few rows."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, base in stream(it, "path", "base"):
                files, at = filesystem(path)
                with files.open_input_file(at) as f:
                    for doc_id, before, ids in Reader(f):
                        yield doc_id, base + before, len(ids), ids.astype("<u4").tobytes()

        yield from batches(rows(), READ, lambda r: 64 + len(r[3]))

    n = max(1, manifest.count())
    dealt = placed.repartition(n, "shard") if n == 1 else placed.repartition(n)
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, tokens binary")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(documents(spark, sf_dir), bpe.vocabulary(), shared_dir(spark, "shards"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
