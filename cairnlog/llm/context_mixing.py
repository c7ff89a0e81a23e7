"""Scoring texts by logistic context mixing.

A text is its words, A-Z lower-cased, each followed by a space, and an end
mark; the model predicts these bytes bit by bit. Six predictors look up the
bit counts of a context each: the place in the word, the last one to four
bytes, and the word so far. Their stretched probabilities are mixed by
two sets of weights, one gated by how often the word so far and the last bytes
were seen, the other by the byte's bits so far; their mean is refined by a map of
the byte's bits so far and the probability. The product over all bits is a
probability of the text: bits per byte follow.

What is learnt from the corpus, all of it from all training rows:

- counts of all training words, one aggregation over words;
- counts of all contexts with their next byte, formed from those counts and
  kept by key (56 bits of the context's hash, and the byte), partitioned by
  ranges of the key whose number follows the vocabulary. A byte's counts of
  bits are sums over the bytes that begin like it, so a range answers with nine
  numbers for each byte that a block of words asks for;
- the mixing weights, by Newton's method for each gate, and the map: sums over
  all distinct words, each as often as it occurs and taken once out of the
  counts that predict it, merged over blocks in a few passes (a parameter).

A spelled word has one probability whatever stands around it: it is computed
once in its block, a range of the words in order, and sent to the blocks of
documents that use it. Words of a block that begin alike share the work on those
bytes. A block of documents is a bounded stretch of a
partition's rows and sends only its distinct words.

Documents are then scored where they are read, by a second mixing that is
online (in_text.py): over that shared start, bits behind the hashed contexts of
the two words and the one word before say whether the word that came last time
comes again, with counters, weights and a map that learn as the text goes on.
Order, repeated lines and phrases of a text count there. What other documents
have in common with it reaches it by the spelling's counts alone.

Null and empty texts: the end mark alone. Very long texts: scored whole. Other columns aren't read. Repeated ids: each row is scored by
itself. Without training documents all counts are 0 and bits are even chances
before mixing. Empty table: no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import in_text
from .common import batches, documents, filesystem, fold, id_and_text, materialise, release, shared_dir, stream
from .parts import read_part, steady, write_by_part

HELD_OUT = 1
BLOCK_BYTES = 24 << 20
#: Tokens that are mixed at once in texts, and bytes at once in words.
TOKENS, PIECE = 1 << 15, 1 << 15
#: Characters of texts that are split at once.
SLICE_CHARS = 4 << 20
#: Words of a block, and contexts' next bytes of a range, on average.
BLOCK_WORDS, RANGE_KEYS = 1 << 15, 1 << 22
ORDERS = 6
#: Passes over all training words that fit the weights; one more fits the map.
PASSES = 2
SPACE, END = b" ", b"\n"
#: Gates: how often the word so far and the last three bytes were seen, in powers of four.
GATES, PLACES, STEPS = 12 * 6, 15, 33
#: Sights that a cell of the map starts with, and the pull of the weights to their start.
INERTIA, PULL = 50, 1.0
#: Tasks of a pass, at most: each hands one row of sums to the driver.
PASS_TASKS = 256
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of texts, one after the other, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    flat = split.flatten()
    # Space characters at a text's ends leave empty words there.
    full = pc.greater(pc.binary_length(flat), 0)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    n = np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(full).cast(pa.binary()).dictionary_encode(), n


def by_block(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows with the number of their block; of few characters, and of one block, at once."""
    release()
    block = size = 0
    for b in it:
        sizes, at = pc.utf8_length(b.column(b.schema.get_field_index("text"))).to_numpy(), 0
        ends = np.cumsum(sizes, dtype=np.int64)
        while at < b.num_rows:
            before = int(ends[at] - sizes[at])
            upto = min(int(np.searchsorted(ends, before + min(SLICE_CHARS, BLOCK_BYTES - size))) + 1, b.num_rows)
            yield block, b.slice(at, upto - at)
            size, at = size + int(ends[upto - 1]) - before, upto
            if size >= BLOCK_BYTES:
                block, size = block + 1, 0


class Bytes:
    """The bytes of units (words with their space, or end marks), flat, with
    the hashed contexts of each byte."""

    def __init__(self, units: list[bytes]):
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        self.starts = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(units), np.uint8).astype(np.int64)
        n = len(self.data)
        self.place = np.arange(n) - np.repeat(self.starts, sizes)
        u = self.data.astype(np.uint64) + np.uint64(1)
        back, shifted = [], u
        for k in range(1, 5):
            shifted = np.concatenate([np.zeros(1, np.uint64), shifted[:-1]]) if n else shifted
            back.append(np.where(self.place >= k, shifted, np.uint64(0)))
        powers = np.uint64(ODD[0]) ** (self.place.astype(np.uint64) + np.uint64(1))
        total = np.cumsum(u * powers, dtype=np.uint64) - u * powers
        prefix = total - np.repeat(total[self.starts] if n else total, sizes)
        contexts, h = [np.minimum(self.place, PLACES).astype(np.uint64)], np.zeros(n, np.uint64)
        for k in range(4):
            h = (h + back[k]) * np.uint64(ODD[k + 1])
            h ^= h >> np.uint64(29)
            contexts.append(h)
        contexts.append(prefix)
        self.contexts = [(c + np.uint64(k + 1)) * np.uint64(ODD[k]) for k, c in enumerate(contexts)]

    def ends(self) -> np.ndarray:
        """A name for each byte with all bytes of its unit before it."""
        h = self.contexts[-1] + (self.data.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD[1])
        return (h ^ (h >> np.uint64(32))) * np.uint64(ODD[2]) + self.place.astype(np.uint64)

    def keys(self, places: np.ndarray) -> np.ndarray:
        """(order, byte): a context's hash above the byte that follows it."""
        h = np.stack([c[places] for c in self.contexts])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(ODD[2])
        return (h & ~np.uint64(255)) | self.data[places].astype(np.uint64)


def unit(word: bytes) -> bytes:
    """A word's bytes; an empty one stands for the end mark."""
    return word + SPACE if word else END


def paths(keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(9, key): how often the key's context was followed by a byte that begins
    with the key's first 0 to 8 bits. Keys are sorted and distinct."""
    out = np.zeros((9, len(keys)), np.int64)
    for k in range(9 if len(keys) else 0):
        begun = keys >> np.uint64(8 - k)
        starts = np.flatnonzero(np.append(True, begun[1:] != begun[:-1]))
        out[k] = np.repeat(np.add.reduceat(times, starts), np.diff(np.append(starts, len(keys))))
    return out


def added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and where each key stands among them."""
    order = np.argsort(keys)
    lined = keys[order]
    new = np.append(True, lined[1:] != lined[:-1])[: len(keys)]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(times[order], starts) if len(starts) else np.zeros(0, np.int64)
    return lined[starts], sums.astype(np.int64), at


class Counts:
    """Distinct keys of units with how often they occur. Bytes behind equal
    beginnings of units have all contexts in common (the longest names it), so
    such bytes are one: `of` tells each byte's place among those."""

    def __init__(self, units: list[bytes], times: np.ndarray):
        whole = Bytes(units)
        self.starts = whole.starts
        times = np.repeat(np.asarray(times, np.int64), np.diff(np.append(whole.starts, len(whole.data))))
        order, new = np.zeros(0, np.int64), np.zeros(0, bool)
        if len(whole.data):
            ends = whole.ends()
            order = np.argsort(ends, kind="stable")
            lined = ends[order]
            new = np.append(True, lined[1:] != lined[:-1])
        firsts = order[new]
        # Numbered as they first occur.
        rank = np.argsort(firsts)
        number = np.empty(len(firsts), np.int64)
        number[rank] = np.arange(len(firsts))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = number[np.cumsum(new) - 1]
        self.times = np.zeros(len(firsts), np.int64)
        if len(firsts):
            self.times[number] = np.add.reduceat(times[order], np.flatnonzero(new))
        firsts = firsts[rank]
        self.data = whole.data[firsts]
        self.keys, self.sums, at = added(whole.keys(firsts).ravel(), np.tile(self.times, ORDERS))
        self.at = at.reshape(ORDERS, -1)

    def keep(self, path: str, attempt: int) -> None:
        """For the passes, which need no keys; a task that runs again leaves the same file."""
        files, at = filesystem(path)
        small = [x.astype(np.int32) for x in (self.starts, self.of, self.at)]
        with files.open_output_stream(f"{at}.{attempt}") as out:
            out.write(packed(pickle.dumps((*small, self.data.astype(np.uint8), self.times))))
        files.move(f"{at}.{attempt}", at)

    @classmethod
    def kept(cls, path: str) -> Counts:
        files, at = filesystem(path)
        with files.open_input_file(at) as f:
            starts, of, where, data, times = pickle.loads(unpacked(f.read()))
        self = cls.__new__(cls)
        self.starts, self.of, self.at, self.data, self.times = starts, of, where, data.astype(np.int64), times
        return self

    def sum(self) -> int:
        """Bits counted."""
        return 8 * int(self.sums.sum())

    def paths_of(self, asked: Counts) -> np.ndarray:
        """Paths of another's keys under these counts."""
        both = np.concatenate([self.keys, asked.keys])
        keys, sums, at = added(both, np.concatenate([self.sums, np.zeros_like(asked.sums)]))
        return paths(keys, sums)[:, at[len(self.keys) :]]


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def count_bits(units: list[bytes], times: np.ndarray) -> Counts:
    return Counts(units, times)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def pieces(places: np.ndarray) -> list[np.ndarray]:
    """What is worked on at once, small enough for a core's cache."""
    return [places[k : k + PIECE] for k in range(0, len(places), PIECE)]


def seen_often(n: np.ndarray) -> np.ndarray:
    """0 for never, then a step for each power of four."""
    return np.where(n > 0, (np.frexp(n)[1] + 1) // 2, 0)


def gate_of(word_so_far: np.ndarray, three_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(word_so_far, 11) * 6 + np.minimum(three_bytes, 5)


class Mixer:
    """The weights and the map."""

    THREE, WORD = 3, 5

    def __init__(self, counts: Counts | None = None):
        self.counts = counts
        self.gated = np.full((GATES, ORDERS + 1), 0.2)
        self.by_byte = np.full((256, ORDERS + 1), 0.2)
        self.map = np.tile(squash(np.linspace(-12, 12, STEPS)), (256, 1))

    def _mix(self, x: np.ndarray, gate: np.ndarray, so_far: np.ndarray) -> tuple:
        a = np.einsum("kn,kn->n", x, self.gated.T.astype(np.float32)[:, gate])
        b = np.einsum("kn,kn->n", x, self.by_byte.T.astype(np.float32)[:, so_far])
        s = np.clip((3 * a + b) / 4, -12, 12)
        at = (s + 12) * np.float32((STEPS - 1) / 24)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        part = at - low
        cell, told = so_far * STEPS + low, self.map.astype(np.float32).ravel()
        refined = told[cell] * (1 - part) + told[cell + 1] * part
        return a, b, cell, part, (3 * squash(s) + refined) / 4

    def _bits(self, asked: Counts, found: np.ndarray, places: np.ndarray, learn: bool) -> Iterator[tuple]:
        """Bits so far, bit, predictors (a row each) and gate of the bits of
        the bytes at these places, from the top. To learn from, each is taken
        out of its counts once."""
        at, data = asked.at[:, places], asked.data[places]
        less = np.float32(learn)
        whole = np.maximum(0, found[0][at] - less)
        for k in range(8):
            so_far, bit = (1 << k) | (data >> (8 - k)), (data >> (7 - k)) & 1
            same = np.maximum(0, found[k + 1][at] - less)
            x = np.empty((ORDERS + 1, len(bit)), np.float32)
            np.log((same + np.float32(0.4)) / (whole - same + np.float32(0.4)), out=x[:ORDERS])
            x[:ORDERS] *= (2 * bit - 1).astype(np.float32)
            x[ORDERS] = 0.3
            yield so_far, bit, x, gate_of(seen_often(whole[self.WORD]), seen_often(whole[self.THREE]))
            whole = same

    def sums(self, asked: Counts, found: np.ndarray, last: bool) -> np.ndarray:
        """What a pass adds up over bytes, each as often as it occurs: slopes
        and curvatures of each gate's weights or, in the last pass, the map's
        sights and ones."""
        wide = ORDERS + 1
        learnt = np.flatnonzero(asked.times > 0)
        out = np.zeros(2 * self.map.size if last else (GATES + 256) * (wide + wide * wide))
        found = found.astype(np.float32)
        for places, so_far, bit, x, gate in ((p, *b) for p in pieces(learnt) for b in self._bits(asked, found, p, True)):
            times = asked.times[places].astype(np.float32)
            a, b, cell, part, _ = self._mix(x, gate, so_far)
            if last:
                for at, share in ((cell, times * (1 - part)), (cell + 1, times * part)):
                    out[: self.map.size] += np.bincount(at, share, self.map.size)
                    out[self.map.size :] += np.bincount(at, share * bit, self.map.size)
                continue
            rows = out.reshape(GATES + 256, -1)
            for first, where, z in ((0, gate, a), (GATES, so_far, b)):
                order = np.argsort(where.astype(np.uint8), kind="stable")
                p = squash(z)
                xs, off, bend = x[:, order], (times * (bit - p)).astype(np.float32)[order], (times * p * (1 - p))[order]
                bent = xs * bend
                seen = np.bincount(where, minlength=256)
                upto = np.cumsum(seen)
                for g in np.flatnonzero(seen):
                    i = slice(upto[g] - seen[g], upto[g])
                    rows[first + g, :wide] += xs[:, i] @ off[i]
                    rows[first + g, wide:] += (bent[:, i] @ xs[:, i].T).ravel()
        return out

    def step(self, sums: np.ndarray, last: bool) -> None:
        if last:
            seen, ones = sums.reshape(2, 256, STEPS)
            self.map = np.clip((INERTIA * self.map + ones) / (INERTIA + seen), 1e-6, 1 - 1e-6)
            return
        wide = ORDERS + 1
        rows = sums.reshape(GATES + 256, -1)
        weights = np.concatenate([self.gated, self.by_byte])
        slope = rows[:, :wide] - PULL * (weights - 0.2)
        bend = rows[:, wide:].reshape(-1, wide, wide) + PULL * np.eye(wide)
        weights += np.clip(np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -1, 1)
        self.gated, self.by_byte = weights[:GATES], weights[GATES:]

    def learn(self, units: list[bytes], counts: Counts) -> None:
        """All passes over units, each occurring once for each time it is listed."""
        asked = Counts(units, np.ones(len(units), np.int64))
        found = counts.paths_of(asked)
        for k in range(PASSES + 1):
            self.step(self.sums(asked, found, k == PASSES), k == PASSES)

    def score(self, units: list[bytes]) -> np.ndarray:
        """log10 probability of each unit under the mixer's own counts."""
        asked = Counts(units, np.zeros(len(units), np.int64))
        return self.score_found(asked, self.counts.paths_of(asked))

    def score_found(self, asked: Counts, found: np.ndarray) -> np.ndarray:
        total = np.zeros(len(asked.data))
        found = found.astype(np.float32)
        for places, so_far, bit, x, gate in ((p, *b) for p in pieces(np.arange(len(total))) for b in self._bits(asked, found, p, False)):
            p = self._mix(x, gate, so_far)[-1]
            total[places] += np.log10(np.where(bit == 1, p, 1 - p), dtype=np.float64)
        return np.add.reduceat(total[asked.of], asked.starts) if len(total) else np.zeros(0)


USES = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("word", pa.binary()), ("times", pa.int64())])


def _uses(docs: DataFrame) -> DataFrame:
    """Each block's distinct words with their number in its training rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("times", "sum")]).combine_chunks()
            for b in found.to_batches(max_chunksize=100_000):
                columns = {"part": np.full(len(b), part), "block": np.full(len(b), now), "word": b.column("word"), "times": b.column("times_sum")}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in USES], schema=USES)
            held.clear()

        for block, rows in by_block(it):
            if block != now:
                yield from flush()
                now = block
            words, n = words_of(rows.column(rows.schema.get_field_index("text")))
            learnt = np.repeat(~rows.column(rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False), n)
            times = np.bincount(words.indices.to_numpy()[learnt], minlength=len(words.dictionary))
            held.append(pa.table({"word": words.dictionary, "times": times}))
        if held:
            yield from flush()

    return docs.mapInArrow(run, "part long, block long, word binary, times long")


def _read_block(uri: str, block: int, columns: list[str]) -> pa.Table:
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, at = filesystem(f"{uri}/block={block}")
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return pa.table({c: [] for c in columns})
    return ds.dataset(at, filesystem=files, format="parquet").to_table(columns=columns)


def _words(uri: str, block: int) -> tuple[list[bytes], np.ndarray]:
    t = _read_block(uri, block, ["word", "times"])
    return t.column("word").to_numpy().tolist(), t.column("times").to_numpy().astype(np.int64)


def _found(uri: str, block: int) -> np.ndarray:
    """Paths of a block's distinct keys: ranges follow the keys' order."""
    rows = sorted(_read_block(uri, block, ["span", "wide", "paths"]).to_pylist(), key=lambda r: r["span"])
    got = [np.frombuffer(unpacked(r["paths"]), f"<i{r['wide']}").reshape(9, -1) for r in rows]
    found = np.concatenate(got, axis=1) if got else np.zeros((9, 0), np.int64)
    # Each row after the first holds what its bit takes off.
    return np.concatenate([found[:1], found[:1] - np.cumsum(found[1:], axis=0)])


ASKED = pa.schema([("span", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])


def _blocks(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, min(n, PASS_TASKS))


def look_up(spark: SparkSession, words: str, kept: str, n_blocks: int, n_spans: int) -> str:
    """The folder of all blocks' paths. Counts meet at the range that owns their
    key; what the passes need of them is kept for each block."""
    shift = 64 - (n_spans.bit_length() - 1)

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(kept)
        files.create_dir(folder, recursive=True)

        def rows() -> Iterator[tuple]:
            for (block,) in stream(it, "id"):
                listed, times = _words(words, block)
                asked = Counts([unit(w) for w in listed], times)
                asked.keep(f"{kept}/{block}", TaskContext.get().taskAttemptId())
                edges = np.searchsorted(asked.keys >> np.uint64(min(shift, 63)), np.arange(n_spans + 1)) if n_spans > 1 else [0, len(asked.keys)]
                for span in range(n_spans):
                    i = slice(edges[span], edges[span + 1])
                    if i.start < i.stop:
                        gaps = np.diff(asked.keys[i], prepend=np.uint64(0)).astype("<u8")
                        yield span, block, gaps.tobytes(), packed(asked.sums[i].astype("<i8").tobytes())

        yield from batches(rows(), ASKED, lambda r: len(r[2]) + len(r[3]))

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(np.frombuffer(k, "<u8"), dtype=np.uint64) for k in frame["keys"]]
        times = [np.frombuffer(unpacked(t), "<i8") for t in frame["times"]]
        distinct, sums, at = added(np.concatenate(keys), np.concatenate(times))
        tree = paths(distinct, sums)
        tree[1:] = tree[:-1] - tree[1:]
        wide = 4 if tree.max() < 1 << 31 else 8
        tree = tree.astype(f"<i{wide}")
        ends = np.cumsum([len(k) for k in keys])
        told = [packed(tree[:, at[e - len(k) : e]].tobytes()) for k, e in zip(keys, ends)]
        return pd.DataFrame({"span": frame["span"], "block": frame["block"], "wide": wide, "paths": told})

    asked = _blocks(spark, n_blocks).mapInArrow(ask, "span long, block long, keys binary, times binary")
    told = asked.groupBy("span").applyInPandas(own, "span long, block long, wide long, paths binary")
    uri = shared_dir(spark, "paths")
    told.repartition("block").write.partitionBy("block").parquet(uri)
    return uri


def train(spark: SparkSession, kept: str, found: str, n_blocks: int) -> Mixer:
    """The mixer, from all training words in all passes."""
    mixer = Mixer()
    for nth in range(PASSES + 1):
        last = nth == PASSES
        held = spark.sparkContext.broadcast(mixer)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for (block,) in stream(it, "id"):
                got = held.value.sums(Counts.kept(f"{kept}/{block}"), _found(found, block), last)
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

        rows = _blocks(spark, n_blocks).mapInArrow(run, "sums binary").collect()
        mixer.step(sum(np.frombuffer(r.sums, "<f8") for r in rows), last)
    return mixer


ANSWERS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("times", pa.binary()), ("logp", pa.binary())])
SCORED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
        ("score", pa.float64()), ("n_bytes", pa.int64()),
    ]
)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    docs = id_and_text(docs).withColumn("held_out", fold() == HELD_OUT)
    spark = docs.sparkSession
    steady(spark)
    uses = materialise(_uses(docs), "uses")
    n_docs = docs.where(~F.col("held_out")).count()
    vocabulary = materialise(uses.groupBy("word").agg(F.sum("times").alias("times")), "vocabulary")
    listed = vocabulary.agg(F.count(F.lit(1)), F.count(F.when(F.col("times") > 0, 1)), F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    distinct, tokens = listed[1] + (n_docs > 0), listed[2] + n_docs
    n_blocks = -(-(listed[0] + 1) // BLOCK_WORDS)
    n_spans = 1 << (ORDERS * (listed[0] + listed[3]) // RANGE_KEYS).bit_length()
    ends = spark.range(1).select(F.lit(b"").alias("word"), F.lit(n_docs).cast("long").alias("times"))
    words = shared_dir(spark, "words")
    # Ranges of words begin alike; a task of the sort holds one, which is a block.
    ranged = vocabulary.unionByName(ends).repartitionByRange(n_blocks, "word").withColumn("block", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    n_blocks = ranged.agg(F.max("block")).first()[0] + 1
    ranged.repartition("block").write.partitionBy("block").parquet(words)
    kept = shared_dir(spark, "kept")
    found = look_up(spark, words, kept, n_blocks, n_spans)
    held = spark.sparkContext.broadcast(train(spark, kept, found, n_blocks))

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("times", pa.int64()), ("logp", pa.float32())])
        for (block,) in stream(it, "id"):
            mine, times = _words(words, block)
            logp = held.value.score_found(Counts.kept(f"{kept}/{block}"), _found(found, block))
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.binary()), pa.array(times), pa.array(logp.astype(np.float32))], schema=schema)

    scored = materialise(_blocks(spark, n_blocks).mapInArrow(each, "word binary, times long, logp float"), "scored")

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        words = group.column("word").chunk(0).cast(pa.large_binary())
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(b"\n", words.type))
        told = {
            "part": group.column("part")[:1], "block": group.column("block")[:1], "words": [packed(line[0].as_py())],
            "times": [group.column("times").to_numpy().astype("<i8").tobytes()], "logp": [group.column("logp").to_numpy().astype("<f4").tobytes()],
        }
        return pa.table(told, schema=ANSWERS)

    answers = uses.select("part", "block", "word").join(scored, "word").groupBy("part", "block").applyInArrow(
        pack, "part long, block long, words binary, times binary, logp binary"
    )
    told = write_by_part(answers, "answers")
    end = float(scored.where(F.length("word") == 0).first().logp)
    scale = tokens + 0.5 * (distinct + 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            got = {r["block"]: r for r in read_part(told, part, ["part", "block", "words", "times", "logp"])}
            place: dict[bytes, int] = {}
            now, base, logp, known = -1, None, None, None
            end_base = np.log10((n_docs + 0.5) / scale)
            for block, b in by_block(it):
                if block != now:
                    now, r = block, got.pop(block, None)
                    listed = unpacked(r["words"]).split(b"\n") if r else []
                    place = dict(zip(listed, range(len(listed))))
                    times = np.frombuffer(r["times"] if r else b"", "<i8")
                    logp = np.append(np.frombuffer(r["logp"] if r else b"", "<f4").astype(float), end)
                    base, known = np.append(np.log10((times + 0.5) / scale), end_base), np.append(times > 0, n_docs > 0)
                words, n = words_of(b.column(b.schema.get_field_index("text")))
                distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
                try:
                    at = np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))
                except KeyError:  # what a word counts is the same in every block, so others would be right
                    raise ValueError("the input's partitions changed between two passes") from None
                size = pc.binary_length(words.dictionary).to_numpy().astype(np.int64)
                indices, n_docs_here = words.indices.to_numpy(), len(n)
                of = np.repeat(np.arange(n_docs_here), n + 1)
                stops = np.cumsum(n + 1)
                ids, wide = np.full(len(of), -1), np.zeros(len(of), np.int64)
                inner = np.ones(len(of), bool)
                inner[stops - 1] = False
                ids[inner], wide[inner] = at[indices], size[indices]
                cells = [
                    b.column(b.schema.get_field_index("doc_id")).to_pylist(), (n + 1).tolist(), np.bincount(of, known[ids], n_docs_here).astype(np.int64).tolist(),
                    np.bincount(of, base[ids], n_docs_here).tolist(), [], np.bincount(of, wide + 1, n_docs_here).astype(np.int64).tolist(),
                ]
                first = done = 0
                while first < n_docs_here:
                    last = min(int(np.searchsorted(stops, done + TOKENS)) + 1, n_docs_here)
                    i = slice(done, stops[last - 1])
                    cells[4] += in_text.score(ids[i], of[i] - first, logp[ids[i]], last - first).tolist()
                    first, done = last, int(stops[last - 1])
                yield from zip(*cells)

        yield from batches(rows(), SCORED)

    ddl = "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    out = docs.mapInArrow(run, ddl)
    return out.select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score", "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
