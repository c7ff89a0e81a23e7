"""Secret scans: rules, and a character convolutional network over candidates.

Rules give the base spans, leftmost and non-overlapping per kind. Candidates
are all runs of 12 or more key characters with a digit, or 20 or more with
letters of both cases; each is scored with the characters around it by a network written
in numpy: embedding, one convolution, maxima over the candidate and over its
context, a hidden layer. Runs longer than the window are scored window by
window, whole, and take the largest score.

The network is trained on labelled findings: the windows of every candidate of
all documents, marked where a base span covers the candidate, each distinct one
once, and generated examples of common key formats and of things that are none
(addresses, numbers, dates, paths). Windows are dealt by hash to shards, whose
number follows theirs, and each shard adds examples of its own. In a round, every
shard goes over all its rows from the shared weights, and the shards' weights are
averaged by their rows. Of marked, other and generated windows, a kind with more
rows than there are generated ones weighs as much as those.

All windows of a run of characters, wherever it stands, are in one of four
disjoint parts by the run's hash: seven tenths train, a tenth calibrates the
scores (Platt's curve; logits to a hundredth), a tenth sets the threshold, the
highest at which the wanted recall of its secrets is reached, and a tenth
measures recall and precision (`Network.measured`). Every candidate is scored.
Those over the threshold that no base span touches become spans of kind
"model"; base spans always stay, and where one touches, it is the finding.

Null and empty texts have no spans. Repeated ids: each row is scanned by
itself. Very long texts are scanned whole. Other columns aren't read. Offsets
are code points, end exclusive. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, filesystem, id_and_text, materialise, shared_dir, stream

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

#: Examples that a shard generates, thrice; windows of a shard on average; rounds over all of them.
TRAIN_EXAMPLES, SHARD, ROUNDS = 6_000, 4_096, 6
#: Tasks of a round, at most: each hands one row of sums to the driver.
ROUND_TASKS = 256
RECALL = 0.995
AROUND, WINDOW, STRIDE = 24, 48, 32
LENGTH = AROUND + WINDOW + AROUND

#: Index of a character in the network's alphabet: 0 outside the text, 1 other, 2 other letter.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + " \n\"'`=:;,.<>()[]{}+/_-@#$%&*!?\\|"
INDEX = {c: k + 3 for k, c in enumerate(ALPHABET)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        w = m[0]
        if not any(c.isdigit() for c in w) and (len(w) < 20 or w == w.lower() or w == w.upper()):
            continue
        out.append(m.span())
    return out


def windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """For each window over a candidate: its text with what is around, and
    where the candidate's part begins and ends there."""
    out = []
    at = start
    while True:
        stop = min(end, at + WINDOW)
        left = text[max(0, at - AROUND) : at]
        out.append((left + text[at:stop] + text[stop : stop + AROUND], len(left), len(left) + stop - at))
        if stop == end:
            return out
        at = min(at + STRIDE, end - WINDOW)


def as_indices(shown: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (examples, length) with the candidate's part at a fixed place, and its mask."""
    x = np.zeros((len(shown), LENGTH), np.int64)
    inside = np.zeros((len(shown), LENGTH), bool)
    for i, (s, a, b) in enumerate(shown):
        row = [INDEX.get(c, 2 if c.isalpha() else 1) for c in s]
        at = AROUND - a
        x[i, at : at + len(row)] = row
        inside[i, AROUND : AROUND + b - a] = True
    return x, inside


#: Window, kind, mark and tenth of the examples.
Rows = list[tuple[tuple[str, int, int], int, int, int]]


class Network:
    """score(texts shown): probability that the candidate is a secret."""

    DIM, WIDTH, FILTERS, HIDDEN = 8, 5, 16, 16

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        wide = self.DIM * self.WIDTH
        self.p = {
            "emb": r.normal(0, 0.3, (len(ALPHABET) + 3, self.DIM)),
            "conv": r.normal(0, (2 / wide) ** 0.5, (wide, self.FILTERS)), "cb": np.zeros(self.FILTERS),
            "hid": r.normal(0, (1 / self.FILTERS) ** 0.5, (3 * self.FILTERS, self.HIDDEN)), "hb": np.zeros(self.HIDDEN),
            "out": r.normal(0, 0.3, self.HIDDEN), "ob": np.zeros(1),
        }
        self.curve, self.threshold = (1.0, 0.0), 0.5
        self.measured: dict[str, float] = {}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0.0

    def state(self) -> np.ndarray:
        """Weights, their moments and the number of steps, flat."""
        return np.concatenate([*(x.ravel() for d in (self.p, self.m, self.v) for x in d.values()), [self.steps]])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.m, self.v):
            for k, x in d.items():
                d[k] = state[at : at + x.size].reshape(x.shape).copy()
                at += x.size
        self.steps = float(state[at])

    def forward(self, x: np.ndarray, inside: np.ndarray) -> dict:
        p, n = self.p, len(x)
        e = p["emb"][x]
        pad = np.pad(e, ((0, 0), (self.WIDTH // 2, self.WIDTH // 2), (0, 0)))
        cols = np.concatenate([pad[:, k : k + LENGTH] for k in range(self.WIDTH)], axis=2)
        c = np.maximum(cols @ p["conv"] + p["cb"], 0)
        within = np.where(inside[:, :, None], c, -1.0)
        beyond = np.where(inside[:, :, None], -1.0, c)
        i1, i2 = within.argmax(1), beyond.argmax(1)
        rows, filters = np.arange(n)[:, None], np.arange(self.FILTERS)
        share = inside / np.maximum(1, inside.sum(1, keepdims=True))
        mean = np.einsum("nl,nlf->nf", share, c)
        pooled = np.concatenate([c[rows, i1, filters], c[rows, i2, filters], mean], axis=1)
        h = np.maximum(pooled @ p["hid"] + p["hb"], 0)
        return {"cols": cols, "c": c, "i1": i1, "i2": i2, "share": share, "pooled": pooled, "h": h, "z": h @ p["out"] + p["ob"]}

    def gradients(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray, weight: float | np.ndarray = 1.0) -> dict:
        p, f = self.p, self.forward(x, inside)
        n, k = len(x), self.FILTERS
        dz = weight * (1 / (1 + np.exp(-f["z"])) - y) / n
        dh = np.outer(dz, p["out"]) * (f["h"] > 0)
        dp = dh @ p["hid"].T
        dc = f["share"][:, :, None] * dp[:, None, 2 * k :]
        rows, filters = np.arange(n)[:, None], np.arange(k)
        dc[rows, f["i1"], filters] += dp[:, :k]
        dc[rows, f["i2"], filters] += dp[:, k : 2 * k]
        dc *= f["c"] > 0
        dcols = dc @ p["conv"].T
        demb = np.zeros_like(p["emb"])
        half = self.WIDTH // 2
        for j in range(self.WIDTH):
            # Column j of position t is the character at t + j - half.
            a, b = max(0, half - j), min(LENGTH, LENGTH + half - j)
            src = x[:, a + j - half : b + j - half].ravel()
            part = dcols[:, a:b, j * self.DIM : (j + 1) * self.DIM].reshape(-1, self.DIM)
            for d in range(self.DIM):
                demb[:, d] += np.bincount(src, part[:, d], len(demb))
        return {
            "emb": demb, "conv": np.einsum("nlw,nlf->wf", f["cols"], dc, optimize=True), "cb": dc.sum((0, 1)),
            "hid": f["pooled"].T @ dh, "hb": dh.sum(0), "out": f["h"].T @ dz, "ob": dz.sum(keepdims=True),
        }

    def learn(self, rows: Rows, weights: np.ndarray, seed: int, batch: int = 64) -> int:
        """A round over all rows of the parts that train; their number."""
        rows = [r for r in rows if r[3] < 7]
        x, inside = as_indices([r[0] for r in rows])
        kinds, y = np.array([r[1] for r in rows], int), np.array([r[2] for r in rows], float)
        order = np.random.default_rng(seed).permutation(len(rows))
        for at in range(0, len(rows), batch):
            i = order[at : at + batch]
            self.steps += 1
            for k, g in self.gradients(x[i], inside[i], y[i], weights[kinds[i]]).items():
                g = g + 1e-4 * self.p[k]
                self.m[k] = 0.9 * self.m[k] + 0.1 * g
                self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
                step = (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)
                self.p[k] = self.p[k] - 0.004 * step
        return len(rows)

    def logits(self, shown: list[tuple[str, int, int]]) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(shown), 256):
            out.append(self.forward(*as_indices(shown[at : at + 256]))["z"])
        return np.concatenate(out)

    def score(self, shown: list[tuple[str, int, int]]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.logits(shown) + b, -30, 30)))


def examples(n: int, seed: int = 5) -> list[tuple[str, int]]:
    """Generated candidates in generated surroundings: common key formats
    (marked 1) and harmless runs (0)."""
    r = random.Random(seed)
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: some(low, 2, 9)
    secret = [
        lambda: "AKIA" + some(up + num, 16, 16), lambda: some("0123456789abcdef", 24, 64),
        lambda: "ghp_" + some(low + up + num, 36, 36), lambda: "sk_live_" + some(low + up + num, 24, 24),
        lambda: "xoxb-" + some(num, 11, 12) + "-" + some(low + up + num, 24, 24),
        lambda: some(low + up + num + "+/", 32, 60) + r.choice(["", "=", "=="]),
        lambda: "AIza" + some(low + up + num + "-_", 35, 35),
        lambda: "eyJ" + some(low + up + num, 20, 40) + "." + some(low + up + num, 20, 60),
        lambda: r.choice(["", "sk_live_"]) + some(low + up + r.choice(["", "+/", "_-"]), 24, 40),
    ]
    title = lambda: word().title()
    plain = [
        lambda: r.choice("-_./").join(r.choice([word, title])() for _ in range(r.randint(4, 7))), lambda: title() + some(low, 18, 30),
        lambda: f"{word()}.{some(num, 1, 2)}@{word()}{some(num, 1, 1)}.example.com", lambda: some(num, 12, 19),
        lambda: f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}-00",
        lambda: f"www.{word()}{some(num, 1, 3)}.com/{word()}/{word()}", lambda: f"/usr/{word()}/{word()}{some(num, 1, 2)}/{word()}.txt",
        lambda: f"{word()}-{word()}-{some(num, 1, 4)}", lambda: word() + "." * r.randint(5, 12) + some(num, 1, 3),
        lambda: f"{some(num, 1, 3)}.{some(num, 1, 3)}.{some(num, 1, 3)}.{some(num, 1, 3)}/{some(num, 2, 2)}",
        lambda: word() + word() + word() + some(num, 1, 2), lambda: "=" * r.randint(6, 30) + some(num, 1, 2) + "=" * 8,
        lambda: f"+{some(num, 2, 2)}-{some(num, 3, 3)}-{some(num, 4, 4)}-{some(num, 2, 3)}",
    ]
    keys = ["key = ", "auth: ", "Bearer ", "credential=", "export KEY=", "", "", ""]
    out = []
    for k in range(n):
        mark = k % 2
        body = r.choice(secret if mark else plain)()
        before = " ".join(word() for _ in range(4)) + r.choice([". ", " ", "\n", ", "])
        if mark:
            before += r.choice(keys)
            quote = r.choice(["", "", '"', "'"])
            body = quote + body + quote
        out.append((before + body + r.choice([" ", ".\n", ", "]) + " ".join(word() for _ in range(4)), mark))
    return out


def dealt(text: str, mark: int | None) -> Iterator[tuple[tuple[str, int, int], int, int]]:
    """Windows of candidates with their mark (one of None is taken from the
    rules) and the tenth of the examples that they are in."""
    spans = base_spans(text) if mark is None else []
    for a, b in candidates(text):
        hit = any(s < b and a < e for s, _, e in spans) if mark is None else mark
        tenth = zlib.crc32(text[a:b].encode()) % 10
        for w in windows(text, a, b):
            yield w, int(hit), tenth


def labelled(texts: list[tuple[str, int | None]]) -> list[tuple[tuple[str, int, int], int, int]]:
    """Windows of candidates with their marks and the text's number."""
    return [(w, m, k) for k, (text, mark) in enumerate(texts) for w, m, _ in dealt(text, mark)]


#: Kinds of examples, which weigh alike where there are enough of each.
OTHER, MARKED, GENERATED = 0, 1, 2


def shard_rows(own: Iterable[tuple], shard: int, most: int) -> Rows:
    """A shard's examples, sorted: its windows (with mark and tenth) and the ones it generates."""
    made = [(w, GENERATED, m, tenth) for t, m in examples(most // 3, 5 + shard) for w, _, tenth in dealt(t, m)]
    return sorted([(w, m, m, tenth) for w, m, tenth in own]) + made


def kind_weights(other: int, marked: int, shards: int, most: int) -> np.ndarray:
    return np.array([*(min(1.0, shards * (most // 3) / max(1, n)) for n in (other, marked)), 1.0])


def highest(scores: np.ndarray, recall: float) -> float:
    """The highest threshold that finds this share of secrets with these scores."""
    good = np.sort(scores)
    return float(good[min(len(good) - 1, int((1 - recall) * len(good)))]) if len(good) else 0.5


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton's method, with the usual smoothed marks."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - goal)) + 1e-3 * w)
    return float(w[0]), float(w[1])


def measures(found: int, true: int, both: int, n: int) -> dict[str, float]:
    return {"recall": both / max(1, true), "precision": both / max(1, found), "windows": n}


def train(texts: list[str], most: int = TRAIN_EXAMPLES, recall: float = RECALL) -> Network:
    """The network of these texts, as one shard."""
    own = {x for t in texts for x in dealt(t, None)}
    marked = sum(m for _, m, _ in own)
    weights, rows, net = kind_weights(len(own) - marked, marked, 1, most), shard_rows(own, 0, most), Network()
    for nth in range(ROUNDS):
        net.learn(rows, weights, nth)
    kinds, y, tenth = (np.array([r[k] for r in rows], int) for k in (1, 2, 3))
    pick = lambda at: [rows[i][0] for i in np.flatnonzero(at)]
    net.curve = platt(np.round(net.logits(pick(tenth == 7)), 2), y[tenth == 7], weights[kinds[tenth == 7]])
    net.threshold = highest(net.score(pick((tenth == 8) & (y == 1))), recall)
    found, true = net.score(pick(tenth == 9)) >= net.threshold, y[tenth == 9] == 1
    net.measured = measures(int(found.sum()), int(true.sum()), int((found & true).sum()), len(found))
    return net


WINDOWS = pa.schema([("shown", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("mark", pa.int32()), ("tenth", pa.int32())])


def read_shard(uri: str, shard: int, most: int) -> Rows:
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, at = filesystem(f"{uri}/shard={shard}")
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return shard_rows([], shard, most)
    found = ds.dataset(at, filesystem=files, format="parquet").to_table(columns=WINDOWS.names).to_pylist()
    return shard_rows((((r["shown"], r["a"], r["b"]), r["mark"], r["tenth"]) for r in found), shard, most)


def train_on(docs: DataFrame, most: int = TRAIN_EXAMPLES, recall: float = RECALL) -> Network:
    """The network of all documents."""
    spark = docs.sparkSession

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*w, m, tenth) for (text,) in stream(it, "text") for w, m, tenth in dealt(text, None))
        yield from batches(rows, WINDOWS, lambda r: 64 + len(r[0]))

    shown = docs.select("text").mapInArrow(run, "shown string, a int, b int, mark int, tenth int")
    shown = materialise(shown.distinct(), "windows")
    count = {r.mark: r["count"] for r in shown.groupBy("mark").count().collect()}
    other, marked = count.get(0, 0), count.get(1, 0)
    n = max(1, -(-(other + marked) // SHARD))
    weights = kind_weights(other, marked, n, most)
    uri = shared_dir(spark, "shards")
    by_shard = shown.withColumn("shard", F.pmod(F.xxhash64(*WINDOWS.names), F.lit(n)))
    by_shard.repartition("shard").write.partitionBy("shard").parquet(uri)
    shards = spark.range(0, n, 1, min(n, ROUND_TASKS))

    net = Network()
    for nth in range(ROUNDS):
        held = spark.sparkContext.broadcast(net.state())

        def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for (shard,) in stream(it, "id"):
                mine = Network()
                mine.load(held.value)
                seen = mine.learn(read_shard(uri, shard, most), weights, nth)
                total = total + seen * np.append(mine.state(), 1.0)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

        sums = sum(np.frombuffer(r.sums, "<f8") for r in shards.mapInArrow(learn, "sums binary").collect())
        net.load(sums[:-1] / sums[-1])

    last = spark.sparkContext.broadcast(net.state())

    def aside(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network()
        mine.load(last.value)
        for (shard,) in stream(it, "id"):
            rows = [r for r in read_shard(uri, shard, most) if r[3] >= 7]
            z = mine.logits([r[0] for r in rows])
            kinds, marks, tenths = ([r[k] for r in rows] for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(marks, pa.int32()), pa.array(tenths, pa.int32()), pa.array(z, pa.float64())], ["kind", "mark", "tenth", "z"])

    z = materialise(shards.mapInArrow(aside, "kind int, mark int, tenth int, z double"), "logits")
    at = z.where("tenth = 7").groupBy("kind", "mark", F.round(F.greatest(F.least("z", F.lit(60.0)), F.lit(-60.0)), 2).alias("z")).count()
    at = at.orderBy("z", "kind", "mark").collect()
    net.curve = platt(*(np.array(x, float) for x in ([r.z for r in at], [r.mark for r in at], [r["count"] * weights[r.kind] for r in at])))
    # What the score grows with, clipped alike: the threshold's place among the secrets is that of `highest`.
    z = z.withColumn("s", F.greatest(F.least(F.col("z") * net.curve[0] + net.curve[1], F.lit(30.0)), F.lit(-30.0)))
    secret = z.where("tenth = 8 AND mark = 1").select("s")
    limit = secret.orderBy("s").offset(int((1 - recall) * secret.count())).limit(1).collect()
    net.threshold = float(1 / (1 + np.exp(-limit[0].s))) if limit else 0.5
    over = F.col("s") >= limit[0].s if limit else F.col("s") >= 0
    got = z.where("tenth = 9").select(over.alias("found"), (F.col("mark") == 1).alias("secret"))
    got = got.agg(*(F.count(F.when(F.expr(x), 1)) for x in ("found", "secret", "found AND secret", "secret IS NOT NULL"))).first()
    net.measured = measures(*got)
    return net


FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
    ]
)
FOUND_DDL = "doc_id long, spans array<struct<kind:string,begin:bigint,end:bigint,score:double>>"


def scan_texts(texts: list[str], net: Network) -> list[list[dict]]:
    base = [base_spans(t) for t in texts]
    shown, owner = [], []
    for i, t in enumerate(texts):
        for a, b in candidates(t):
            for w in windows(t, a, b):
                shown.append(w)
                owner.append((i, a, b))
    best: dict[tuple, float] = {}
    for key, p in zip(owner, net.score(shown)):
        best[key] = max(best.get(key, 0.0), float(p))
    found = [[(s, k, e, 1.0) for s, k, e in spans] for spans in base]
    for (i, a, b), p in best.items():
        if p >= net.threshold and not any(s < b and a < e for s, _, e in base[i]):
            found[i].append((a, 3, b, p))
    return [[{"kind": KINDS[k], "begin": s, "end": e, "score": p} for s, k, e, p in sorted(f)] for f in found]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and spans (kind, begin, end, score), sorted by begin and kind."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            some: list[tuple] = []
            for r in stream(it, "doc_id", "text"):
                some.append(r)
                if len(some) == 256:
                    yield from zip((d for d, _ in some), scan_texts([t for _, t in some], held.value))
                    some = []
            yield from zip((d for d, _ in some), scan_texts([t for _, t in some], held.value))

        yield from batches(rows(), FOUND, lambda r: 64 + 40 * len(r[1]))

    return docs.mapInArrow(run, FOUND_DDL)


def secrets(docs: DataFrame) -> DataFrame:
    docs = id_and_text(docs)
    return scan(docs, train_on(docs))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
