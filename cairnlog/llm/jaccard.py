"""N-gram Jaccard join, size-aware: subsets for small sets, lists for large ones.

A document's set is its distinct word n-grams (64-bit hashes). Documents with
equal sets form a class (128-bit hash of the set); only a class's first
document goes on. Two sets link when 100 * intersection >= percent * union.

Small sets: linked sets share their intersection, which lacks at most a few
elements of either. Each small set sends the hashes of all its subsets that
are large enough; in each group the smallest set is the hub. If two members
link by this subset, both link to the hub by it too, so edges to the hub lose
no connection and are linear in the group.

Large sets: linked sets must share one of their first s - ceil(s * percent /
100) + 1 elements, in any order that is the same for all. Here elements that
one set alone has come first, then those of few sets, then the rest, each by
hash. What others have is found by an exchange: every block of documents sends
its distinct elements, Golomb-coded, to the owners of hash ranges, and gets
back bitmaps (another set has it; many have it). A set with too many elements
of its own can link with nothing and is done; the others list the rest of
their first elements. Each list's hub is the member
with the fewest elements of its own; all others are compared with it, which is
linear in the list. Of what the hubs leave apart, differences are listed: two
sets x and y that link, of which one doesn't link to the hub h, share at least
(|x - h| + |y - h| - d) / 2 elements of their differences from h, the elements
that only one of x and h has, where |x - h| counts them and d is the largest
difference that sets of these sizes may have; a member whose differences without
its own elements are too few for that with any other is done. So in place of what a large
group has in common, members are listed by their rarest differences, as many
as the bound needs for each band of the other's distance; those lists have
hubs again, and so on while comparing them in full would cost too much. Of
lists with few pairs for their members all pairs in different components that
sizes and own elements allow are compared, so no link is lost; pairs already connected need no comparison,
since the result is the components.

Every pass checks that it sees the rows of the first one (parts.py).

The size up to which subsets are enumerated is the one with the least rows to
move, from the count of sets of each size.

Null texts and texts without words: empty set, linked with nothing. Fewer words
than n: the whole sequence is the one element. Repeated ids: each row is a
document. Null ids come last in "smallest". Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golomb
from .common import batches, documents, id_and_text, materialise, release, stream
from .components import components
from .parts import Own, ends, print_of, read_part, row_id, rows_by_part, steady, write_by_part

WORDS, PERCENT = 3, 90
#: What an exchanged and a listed element cost, against one subset; the largest size that may be enumerated.
SENT_COST, LISTED_COST, LARGEST_SMALL = 0.3, 3, 40
#: Text of a block, elements an owner is meant to hold, the least number of owners, and what counts as many sets.
BLOCK_BYTES, OWNER_ITEMS, LEAST_OWNERS, MANY = 8 << 20, 1 << 21, 256, 8
BATCH_CHARS = 1 << 18
#: Pairs of a list, for each of its members, above which their differences are listed first; so often at most.
PAIRS, LEVELS = 8, 4
ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
     0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64,
)

#: A value for each byte, none for the space characters that part words, and the powers it is multiplied with.
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_VALUES[[9, 10, 11, 12, 13, 32]] = 0
_POWERS = np.cumprod(np.full(256, ODD[0]), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte string, and where they start."""
    x = _VALUES[np.frombuffer(data, np.uint8)]
    inside = x != 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = np.diff(np.append(starts, len(x)))
    place = np.arange(starts[0], len(x)) - np.repeat(starts, sizes)
    powers = _POWERS if place.max() < len(_POWERS) else np.cumprod(np.full(int(place.max()) + 1, ODD[0]), dtype=np.uint64)
    return mixed(np.add.reduceat(x[starts[0] :] * powers[place], starts - starts[0])), starts


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its word n-grams; words
    are lower-cased A-Z. All texts are hashed at once."""
    datas = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    h, starts = word_hashes(b" ".join(datas))
    edges = np.cumsum([0, *(len(d) + 1 for d in datas)])
    edges = np.searchsorted(starts, edges).tolist()
    wide = max(0, len(h) - n + 1)
    total = np.full(wide, n, np.uint64)
    for j in range(n):
        total += h[j : j + wide] * ODD[j % len(ODD)]
        total = total if j % len(ODD) < len(ODD) - 1 else mixed(total)
    total = mixed(total)
    out = []
    for a, b in zip(edges, edges[1:]):
        if 0 < b - a < n:
            items = mixed((h[a:b] * ODD[np.arange(b - a) % len(ODD)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            items = np.sort(total[a : max(a, b - n + 1)])
            if len(items) > 1:
                items = items[np.append(True, items[1:] != items[:-1])]
        out.append(items)
    return out


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    return shingle_sets([text], n)[0]


def with_sets(rows: Iterator[tuple], n: int) -> Iterator[tuple]:
    """Rows that end in a text with its set in place of it; texts are hashed
    together up to a bounded size, and rows without a text pass as they are."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or "")
        if size >= BATCH_CHARS or len(held) >= 4096:
            yield from _with_sets(held, n)
            held, size = [], 0
    yield from _with_sets(held, n)


def _with_sets(held: list[tuple], n: int) -> Iterator[tuple]:
    sets = iter(shingle_sets([r[-1] for r in held if r[-1] is not None], n))
    return ((*r[:-1], next(sets) if r[-1] is not None else None) for r in held)


def least_overlap(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def n_subsets(size: int, percent: int) -> int:
    return sum(comb(size, d) for d in range(size - least_overlap(size, percent) + 1))


def subsets(items: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """(hashes, size) of all subsets that could be an intersection with a linked set."""
    from itertools import combinations

    each = mixed(items * ODD[0])
    whole = each.sum(dtype=np.uint64)
    n = len(items)
    for d in range(n - least_overlap(n, percent) + 1):
        if d == 0:
            gone = np.zeros(1, np.uint64)
        else:
            gone = each[np.array(list(combinations(range(n), d)))].sum(axis=1, dtype=np.uint64)
        yield mixed(whole - gone + np.uint64(n - d)), n - d


def boundary(counts: dict[int, int], percent: int) -> int:
    """The size below which sets are enumerated: that with the least rows in all.
    Sets that link across it, a little larger, are both enumerated and listed."""
    def cost(b: int) -> float:
        upto = (b - 1) * 100 // percent if b else 0
        rows = 0.0
        for s, n in counts.items():
            rows += n * n_subsets(s, percent) if s <= upto else 0
            rows += n * (SENT_COST * s + LISTED_COST * (s - least_overlap(s, percent) + 1)) if s >= b else 0
        return rows

    return min(range(1, LARGEST_SMALL + 1), key=lambda b: (cost(b), b))


SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("size", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
KEYS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("row", pa.int64()), ("size", pa.int32()), ("extra", pa.int32())])
KEYS_DDL = "kind byte, key long, row long, size int, extra int"
#: kind of a key row: a listed element (extra: the set's elements that no other has), a subset (extra: its size).
LISTED, SUBSET = 0, 1
SENT = pa.schema(
    [
        ("part", pa.int64()), ("block", pa.int64()), ("owner", pa.int64()), ("shared", pa.binary()), ("many", pa.binary()),
        ("list", pa.binary()),
    ]
)
SENT_DDL = "part long, block long, owner long, shared binary, many binary, list binary"


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for k, (doc_id, seen, s) in enumerate(with_sets(stream(it, "doc_id", "print", "text"), n)):
                h = xxhash.xxh3_128_digest(s.tobytes())
                yield row_id(part, k), doc_id, seen, len(s), *np.frombuffer(h, "<i8").tolist()

        yield from batches(rows(), SETS)
        release()

    return docs.mapInArrow(run, "row long, doc_id long, print long, size long, high long, low long")


def _blocks(it: Iterator[pa.RecordBatch], firsts: str, part: int, n: int, border: int) -> Iterator[tuple[int, list]]:
    """(block, rows): stretches of bounded text, with row number, text size and
    set of each first document of a class. The same in every pass."""
    held: list[tuple[int, np.ndarray]] = []
    block, size = 0, 0
    for row, chars, s in with_sets(_chosen(it, firsts, part), n):
        if s is not None:
            held.append((row, s))
        size += chars
        if size >= BLOCK_BYTES:
            yield block, held
            held, block, size = [], block + 1, 0
    if held:
        yield block, held
    release()


def _chosen(it: Iterator[pa.RecordBatch], wanted: str, part: int) -> Iterator[tuple]:
    """row, size and text (null where the side table doesn't name the row)."""
    mine, k = Own(wanted, part), -1
    for k, (text, seen) in enumerate(stream(it, "text", "print")):
        yield row_id(part, k), len(text), text if mine.has(k, seen) else None
    mine.done(k + 1)


def _send(docs: DataFrame, firsts: str, n: int, border: int, owners: int) -> DataFrame:
    """Each block's distinct elements of large sets, a list for each owner,
    with bitmaps of those that several, or many, of the block's sets have."""
    base = golomb.starts(owners)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for block, held in _blocks(it, firsts, part, n, border):
                large = [s for _, s in held if len(s) >= border]
                if not large:
                    continue
                values, counts = np.unique(np.concatenate(large), return_counts=True)
                cut = [*np.searchsorted(values, base).tolist(), len(values)]
                for k in range(owners):
                    a, b = cut[k], cut[k + 1]
                    if a < b:
                        c = counts[a:b]
                        yield part, block, k, golomb.bitmap(c > 1), golomb.bitmap(c > MANY), golomb.encode(values[a:b] - base[k])

        yield from batches(rows(), SENT, lambda r: 64 + len(r[5]))

    return docs.mapInArrow(run, SENT_DDL)


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps for each list: do other sets have it, do many."""
    lists = [golomb.decode(x) for x in frame["list"]]
    ends = np.cumsum([len(x) for x in lists])
    values, at, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    out = {"part": frame["part"], "block": frame["block"], "owner": frame["owner"]}
    for name, least in (("shared", 1), ("many", MANY)):
        own = np.concatenate([golomb.flags(m, len(x)) for m, x in zip(frame[name], lists)])
        all_ = counts > least
        all_[at[own]] = True
        out[name] = [golomb.bitmap(x) for x in np.split(all_[at], ends[:-1])]
    return pd.DataFrame(out)


def _keys(docs: DataFrame, firsts: str, sent: str, answers: str, n: int, percent: int, border: int, owners: int) -> DataFrame:
    """The subsets of small sets, the listed elements of large ones."""
    upto = (border - 1) * 100 // percent
    base = golomb.starts(owners)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        total = 0

        def batch() -> pa.RecordBatch:
            kinds, keys, rows, sizes, extras = zip(*held)
            lens = [len(k) for k in keys]
            arrays = [
                np.repeat(np.array(kinds, np.int8), lens), np.concatenate(keys).astype(np.int64),
                np.repeat(np.array(rows, np.int64), lens), np.repeat(np.array(sizes, np.int32), lens),
                np.repeat(np.array(extras, np.int32), lens),
            ]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=KEYS)

        for block, sets in _blocks(it, firsts, part, n, border):
            values, rank = np.zeros(0, np.uint64), np.zeros(0, np.int8)
            if any(len(s) >= border for _, s in sets):
                lists = {r["owner"]: r["list"] for r in read_part(sent, part, ["owner", "list"], block)}
                maps = {r["owner"]: r for r in read_part(answers, part, ["owner", "shared", "many"], block)}
                some, ranks = [], []
                for k in sorted(lists):
                    v = golomb.decode(lists[k])
                    some.append(v + base[k])
                    ranks.append(golomb.flags(maps[k]["shared"], len(v)).astype(np.int8) + golomb.flags(maps[k]["many"], len(v)))
                values, rank = np.concatenate(some), np.concatenate(ranks)
            for row, s in sets:
                size = len(s)
                if size <= upto:
                    for hashes, left in subsets(s, percent):
                        held.append((SUBSET, hashes, row, size, left))
                        total += len(hashes)
                if size >= border:
                    at = np.searchsorted(values, s)
                    if at[-1] >= len(values) or (values[at] != s).any():
                        raise ValueError("a set isn't the one that was sent")
                    r = rank[at]
                    alone = int((r == 0).sum())
                    first = size - least_overlap(size, percent) + 1 - alone
                    if first > 0:
                        order = np.argsort(r[r > 0], kind="stable")[:first]
                        held.append((LISTED, s[r > 0][order], row, size, alone))
                        total += len(order)
                if total >= 200_000:
                    yield batch()
                    held, total = [], 0
        if held:
            yield batch()

    return docs.mapInArrow(run, KEYS_DDL)


def _contents(docs: DataFrame, wanted: str, n: int) -> DataFrame:
    """row and its set, little-endian unsigned 64-bit, of the rows in the side table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for row, _, s in with_sets(_chosen(it, wanted, part), n):
                if s is not None:
                    yield row, s.tobytes()
            release()

        yield from batches(rows(), pa.schema([("row", pa.int64()), ("items", pa.binary())]), lambda r: 64 + len(r[1]))

    return docs.mapInArrow(run, "row long, items binary")


def _linked(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link, compared element by element."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def rows() -> Iterator[tuple]:
            for a, b, x, y in stream(it, "a", "b", "x", "y"):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    yield a, b

        yield from batches(rows(), schema)

    left = contents.select(F.col("row").alias("a"), F.col("items").alias("x"))
    right = contents.select(F.col("row").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near(one: str, other: str, percent: int):
    """Could sets of these sizes and own elements link: the smaller one, less
    the elements that no other set has, would have to be the intersection."""
    both = F.least(F.col(f"{one}.size") - F.col(f"{one}.alone"), F.col(f"{other}.size") - F.col(f"{other}.alone"))
    return 100 * both >= percent * (F.col(f"{one}.size") + F.col(f"{other}.size") - both)


def _pair(one: str, other: str) -> list:
    return [F.least(f"{one}.row", f"{other}.row").alias("a"), F.greatest(f"{one}.row", f"{other}.row").alias("b")]


def _hubs(lists: DataFrame) -> DataFrame:
    """Each list's hub: the member with the fewest own elements for its size."""
    ratio = F.col("alone") / F.col("size")
    return lists.groupBy("key").agg(F.min(F.struct(ratio.alias("ratio"), "row", "size", "alone")).alias("hub"))


def _to_hubs(lists: DataFrame, percent: int) -> DataFrame:
    """Each member with its list's hub: linear in the members."""
    pairs = lists.join(_hubs(lists), "key").where("row <> hub.row")
    pairs = pairs.select(F.struct("row", "size", "alone").alias("member"), "hub")
    return pairs.where(_near("member", "hub", percent)).select(*_pair("member", "hub")).distinct()


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists with members of several components, with each member's root,
    and whether the list has many pairs across components."""
    at = lists.join(roots, lists.row == roots.node, "left")
    at = at.select("key", "row", "size", "alone", F.coalesce("root", "row").alias("root"))
    n = at.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key")
    n = n.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    pairs = (F.col("n") * F.col("n") - F.col("same")) / 2
    several = n.where(pairs > 0).select("key", (pairs > PAIRS * F.col("n")).alias("heavy"))
    return materialise(at.join(several, "key"), "open")


def _by_size(lists: DataFrame, percent: int) -> DataFrame:
    """Lists of members that are alike in size: classes are as wide as links
    reach, and each list has two of them, so those that link share a list."""
    nth = F.floor(F.log("size") / F.lit(float(np.log(100 / percent) + 1e-9))).cast("int")
    lists = lists.withColumn("nth", F.explode(F.array(nth, nth + 1)))
    return lists.select(F.xxhash64("key", "nth").alias("key"), "row", "size", "alone", "root")


APART = pa.schema(
    [
        ("hub", pa.int64()), ("row", pa.int64()), ("size", pa.int32()), ("alone", pa.int32()), ("apart", pa.int32()),
        ("linked", pa.bool_()), ("items", pa.list_(pa.int64())),
    ]
)
APART_DDL = "hub long, row long, size int, alone int, apart int, linked boolean, items array<long>"


def _apart(lists: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """For each member of a list and its hub: whether they link, and the
    elements that only one of them has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for hub, row, size, alone, x, y in stream(it, "hub", "row", "size", "alone", "x", "y"):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                items = np.setxor1d(p, q, assume_unique=True)
                linked = 100 * (len(p) + len(q) - len(items)) >= percent * (len(p) + len(q) + len(items))
                yield hub, row, size, alone, len(items), linked, items.astype(np.int64)

        yield from batches(rows(), APART, lambda r: 64 + 8 * r[4])

    pairs = lists.join(_hubs(lists), "key").where("row <> hub.row").select(F.col("hub.row").alias("hub"), "row", "size", "alone").distinct()
    hubs = contents.select(F.col("row").alias("hub"), F.col("items").alias("y"))
    members = contents.select("row", F.col("items").alias("x"))
    return pairs.join(members, "row").join(hubs, "hub").mapInArrow(run, APART_DDL)


def _by_difference(apart: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Lists by elements of the members' differences from their hub: any two
    members that link and lie in different components share a list."""
    at = apart.join(roots, apart.row == roots.node, "left").withColumn("root", F.coalesce("root", "row")).drop("node")
    at = at.withColumn("band", F.floor(F.log("apart") / F.lit(float(np.log(1.25)))).cast("int"))
    bands = at.groupBy("hub", "band").agg(
        F.min("apart").alias("lo"), F.max(F.col("apart") - 2 * F.col("alone")).alias("reach"), F.max("size").cast("long").alias("most"),
        F.min("root").alias("r0"), F.max("root").alias("r1"),
    )
    # One row for each hub, of as many bands as distances have.
    bands = bands.groupBy("hub").agg(
        F.collect_list(F.struct("band", "lo", "reach", "most", "r0", "r1")).alias("bands"), F.min("r0").alias("r0"), F.max("r1").alias("r1")
    ).where("r0 <> r1").select("hub", "bands")

    def furthest(other) -> Column:
        size = F.least(other["most"], F.floor(F.col("size") * 100 / percent))
        return F.floor((100 - percent) * (F.col("size") + size) / (100 + percent))

    # Own elements are among the differences and can't be shared, so a pair differs by
    # at least one's distance, less the other's, and twice the other's own elements.
    def within(other) -> Column:
        near = (other["lo"] - F.col("apart") + 2 * F.col("alone") <= furthest(other)) & (F.col("apart") - other["reach"] <= furthest(other))
        return near & ~((other["r0"] == F.col("root")) & (other["r1"] == F.col("root")))

    # Of each row only the bands in which a member of another component could link to it.
    at = at.join(bands, "hub").withColumn("bands", F.filter("bands", within)).where(F.size("bands") > 0)
    at = materialise(at, "banded")
    # Elements that members of one component alone have can't be shared by a pair in question.
    each = at.select("hub", "row", "root", F.explode("items").alias("item"))
    shared = each.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    shared = shared.where("r0 <> r1").select("hub", "item", "n")
    listed = each.join(shared, ["hub", "item"]).groupBy("hub", "row").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("listed"))
    at = at.drop("items", "root", "linked").join(listed, ["hub", "row"])
    at = at.withColumn("other", F.explode("bands"))
    need = F.greatest(F.lit(1), F.ceil((F.col("apart") + F.col("other.lo") - furthest(F.col("other"))) / 2))
    first = (F.size("listed") - need + 1).cast("int")
    at = at.withColumn("first", first).where("first > 0")
    item = F.explode(F.slice("listed", F.lit(1), F.col("first"))).alias("of")
    at = at.select("hub", "row", "size", "alone", F.least("band", "other.band").alias("b0"), F.greatest("band", "other.band").alias("b1"), item)
    lists = at.select(F.xxhash64("hub", "of.item", "b0", "b1").alias("key"), "row", "size", "alone")
    several = lists.groupBy("key").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("key")
    return materialise(lists.join(several, "key"), "lists")


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list's members that lie in different components."""
    x, y = lists.alias("x"), lists.alias("y")
    return (
        x.join(y, F.col("x.key") == F.col("y.key"))
        .where((F.col("x.root") < F.col("y.root")) & _near("x", "y", percent))
        .select(*_pair("x", "y"))
    )


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """row (monotonically_increasing_id of the input), doc_id, print (of the
    input row), n_shingles, component_id and stays (true for one row of each
    component)."""
    spark = docs.sparkSession
    steady(spark)
    docs = id_and_text(docs, print_of().alias("print"))
    sets = materialise(_sets(docs, words), "sets")
    filled = sets.where("size > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "print"))
    classes = filled.groupBy("high", "low").agg(first.alias("first"), F.first("size").alias("size"))
    classes = materialise(classes.select("high", "low", "size", "first.none", "first.doc_id", "first.row", "first.print"), "classes")
    last = materialise(ends(sets), "ends")

    counts = {r["size"]: r["count"] for r in classes.where(F.col("size") <= 4 * LARGEST_SMALL).groupBy("size").count().collect()}
    border = boundary(counts, percent)
    firsts = rows_by_part(classes.select("row", "print").unionByName(last), "firsts")
    items = classes.where(F.col("size") >= border).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    owners = max(LEAST_OWNERS, -(-items // OWNER_ITEMS))
    sent = write_by_part(_send(docs, firsts, words, border, owners), "sent", gather=False)
    replies = spark.read.schema(SENT_DDL).parquet(sent).select("part", "block", "owner", "shared", "many", "list")
    replies = replies.groupBy("owner").applyInPandas(_answer, "part long, block long, owner long, shared binary, many binary")
    answers = write_by_part(replies, "answers")
    keys = materialise(_keys(docs, firsts, sent, answers, words, percent, border, owners), "keys")

    # Small sets: to the smallest member of each subset's group.
    sub = keys.where(F.col("kind") == SUBSET).select("key", "row", "size", "extra")
    hubs = sub.groupBy("key", "extra").agg(F.min(F.struct("size", "row")).alias("hub"), F.max("row").alias("hi"), F.min("row").alias("lo"))
    hubs = hubs.where("hi <> lo").select("key", "extra", "hub")
    near = 100 * F.col("extra") >= percent * (F.col("size") + F.col("hub.size") - F.col("extra"))
    by_subset = sub.join(hubs, ["key", "extra"]).where(near & (F.col("row") != F.col("hub.row")))
    by_subset = by_subset.select(F.least("row", "hub.row").alias("a"), F.greatest("row", "hub.row").alias("b")).distinct()

    # Large sets: lists of several members.
    listed = keys.where(F.col("kind") == LISTED).select("key", "row", "size", F.col("extra").alias("alone"))
    several = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    lists = materialise(listed.join(several, "key"), "lists")

    pairs = materialise(by_subset.unionAll(_to_hubs(lists, percent)).distinct(), "pairs")
    members = lists.select("row").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
    members = classes.select("row", "print").join(members, "row").unionByName(last)
    contents = materialise(_contents(docs, rows_by_part(members, "members"), words), "contents")

    roots = components(_linked(pairs, contents, percent))
    rest = []
    for level in range(LEVELS + 1):
        lists = _open(lists, roots)
        heavy = lists.where("heavy") if level < LEVELS else lists.where("false")
        rest.append(_across(lists.where("not heavy") if level < LEVELS else lists, percent))
        if heavy.isEmpty():
            break
        apart = materialise(_apart(_by_size(heavy, percent), contents, percent), "apart")
        found = apart.where("linked").select(F.least("hub", "row").alias("a"), F.greatest("hub", "row").alias("b"))
        roots = components(roots.toDF("a", "b").unionAll(found))
        lists = _by_difference(apart, roots, percent)
    more = materialise(reduce(DataFrame.unionAll, rest).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").unionAll(_linked(more, contents, percent)))

    joined = classes.join(roots, classes.row == roots.node, "left").select("high", "low", "none", "doc_id", "row", F.coalesce("root", "row").alias("root"))
    best = joined.groupBy("root").agg(F.min(F.struct("none", "doc_id", "row")).alias("best"))
    named = joined.join(best, "root").select("high", "low", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("stay"))
    named = materialise(named, "named")
    out = filled.join(named, ["high", "low"]).select(
        "row", "doc_id", "print", F.col("size").alias("n_shingles"), "component_id", (F.col("row") == F.col("stay")).alias("stays")
    )
    empty = sets.where("size = 0").select("row", "doc_id", "print", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return out.unionByName(empty)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), i AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS k FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + {WORDS - 1}], ' ') AS g FROM i
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), e AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.size, q.size
  HAVING 100 * count(*) >= {PERCENT} * (p.size + q.size - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = w.doc_id
"""
