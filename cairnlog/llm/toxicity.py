"""Toxic spans by a linear-chain conditional random field.

Two states, inside a toxic span or not. A token is scored by features of its
lower-cased letters (the word, its first 3 to 6 and last 3 characters, its
shape); neighbours speak through the chain's transitions. Marginals from
forward-backward give the offending spans with their offsets (code points, end
exclusive), and their sum and maximum give the document's score by a logistic
curve. The chain of a document of any length is computed whole, as products
of 2 x 2 matrices over runs of tokens.

Labels are of documents, so tokens are labelled from them: in documents marked
toxic, those whose word or beginning stands in many marked documents and in
almost no others. Marked texts that share a passage count once.

Only rows outside the held-out fold train the model, about `most` marked and
three times as many other documents (a parameter), taken by hash of the id. Everything is scored. Without labels of both kinds every score is the
share of marked labels (0 without any label). Null and empty texts: a chain of
no tokens. Repeated label rows of one id: marked if any is; null marks are
ignored. Repeated ids: each row is scored by itself. Empty table: no rows.
"""

from __future__ import annotations

import pickle
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import batches, documents, fold, id_and_text, release, stream

SAMPLE = 1200
RUN = 64
#: Tokens scored at once, and windows that train the chain.
TOKENS, WINDOWS, STEPS = 200_000, 10_000, 50
#: Unmarked documents to one marked document of the sample, at most.
UNMARKED = 3
#: A toxic word or beginning: log of its share in marked texts over that in others,
#: and the chance that any feature does so well by luck.
LEAST_LIFT, LUCK = 4.3, 0.05
MEMO = 300_000
#: Odd numbers that turn one hash into three.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
ROUNDS = 3
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‚‘’…–—"


def word_features(token: str) -> list[str]:
    w = token.strip(MARKS)
    shape = "a" if w.isalpha() else "".join(sorted({"d" if c.isdigit() else "a" if c.isalpha() else "o" for c in w}))
    found = [f"s={shape}{min(len(w), 8)}"]
    if w:
        found += [f"w={w}", f"e={w[-3:]}"]
        found += [f"b={w[:n]}" for n in (3, 4, 5, 6) if len(w) > n]
    return found


def spread(trans: np.ndarray, emissions: np.ndarray, present: np.ndarray) -> list[np.ndarray]:
    """The four entries of each token's step matrix, (run, chains): transition
    times emission; the identity where no token is."""
    e = np.exp(np.clip(emissions, -30, 30))
    t = np.exp(trans)
    return [
        np.where(present, t[0, 0], 1.0), np.where(present, t[0, 1] * e, 0.0),
        np.where(present, t[1, 0], 0.0), np.where(present, t[1, 1] * e, 1.0),
    ]


def marginals(emissions: list[np.ndarray], trans: np.ndarray, start: float) -> list[np.ndarray]:
    """For each chain (log-odds of each token) the probability of the toxic
    state at each token. Runs of tokens are multiplied for all chains at once,
    then joined along each chain, then filled in."""
    lengths = np.array([len(e) for e in emissions])
    runs = np.maximum(1, -(-lengths // RUN))
    first = np.concatenate([[0], np.cumsum(runs)])
    n = int(first[-1])
    if not n:
        return []
    flat = np.zeros(n * RUN)
    there = np.zeros(n * RUN, bool)
    for e, f in zip(emissions, first):
        flat[f * RUN : f * RUN + len(e)] = e
        there[f * RUN : f * RUN + len(e)] = True
    m00, m01, m10, m11 = spread(trans, flat.reshape(n, RUN).T, there.reshape(n, RUN).T)

    # The product of each run's matrices.
    p = [np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)]
    for k in range(RUN):
        q = [
            p[0] * m00[k] + p[1] * m10[k], p[0] * m01[k] + p[1] * m11[k],
            p[2] * m00[k] + p[3] * m10[k], p[2] * m01[k] + p[3] * m11[k],
        ]
        top = q[0] + q[1] + q[2] + q[3]
        p = [x / top for x in q]
    # Along each chain: what reaches a run from the left and from the right.
    left, right = np.empty((n, 2)), np.empty((n, 2))
    a = np.tile([1.0, np.exp(start)], (len(runs), 1))
    b = np.ones((len(runs), 2))
    for k in range(int(runs.max())):
        at = np.flatnonzero(runs > k)
        i = first[at] + k
        left[i] = a[at]
        nxt = np.stack([a[at, 0] * p[0][i] + a[at, 1] * p[2][i], a[at, 0] * p[1][i] + a[at, 1] * p[3][i]], 1)
        a[at] = nxt / nxt.sum(1, keepdims=True)
        j = first[at + 1] - 1 - k
        right[j] = b[at]
        nxt = np.stack([p[0][j] * b[at, 0] + p[1][j] * b[at, 1], p[2][j] * b[at, 0] + p[3][j] * b[at, 1]], 1)
        b[at] = nxt / nxt.sum(1, keepdims=True)
    # Within each run.
    f0, f1 = np.empty((RUN, n)), np.empty((RUN, n))
    x0, x1 = left[:, 0], left[:, 1]
    for k in range(RUN):
        x0, x1 = x0 * m00[k] + x1 * m10[k], x0 * m01[k] + x1 * m11[k]
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
        f0[k], f1[k] = x0, x1
    y0, y1 = right[:, 0], right[:, 1]
    for k in range(RUN - 1, -1, -1):
        f0[k] *= y0
        f1[k] *= y1
        y0, y1 = m00[k] * y0 + m01[k] * y1, m10[k] * y0 + m11[k] * y1
        s = y0 + y1
        y0, y1 = y0 / s, y1 / s
    got = (f1 / (f0 + f1)).T.reshape(-1)
    return [got[f * RUN : f * RUN + n] for f, n in zip(first, lengths)]


class Model:
    """What training yields: feature weights, transitions, and the score's curve."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, start: float, curve: tuple, base: float):
        self.weights, self.bias, self.trans, self.start = weights, bias, trans, start
        self.curve, self.base = curve, base
        self.memo: dict[str, float] = {}

    def emission(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        get = self.weights.get
        for t in set(tokens).difference(memo):
            memo[t] = self.bias + sum(get(f, 0.0) for f in word_features(t))
        return np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        return marginals([self.emission(t.lower().split()) for t in texts], self.trans, self.start)

    def score(self, found: np.ndarray) -> float:
        if self.curve is None:
            return self.base
        z = float(np.dot(self.curve, evidence(found)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def evidence(found: np.ndarray) -> np.ndarray:
    """Of a document's marginals: 1, log of their sum, log of the largest."""
    if not len(found):
        return np.array([1.0, np.log(1e-4), np.log(1e-4)])
    return np.array([1.0, np.log(1e-4 + found.sum()), np.log(1e-4 + found.max())])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _apart(texts: list[list[str]]) -> list[int]:
    """Indices without those texts that share one of three min-hashes of word passages."""
    seen, out = set(), []
    for i, words in enumerate(texts):
        grams = (" ".join(words[k : k + 6]) for k in range(max(1, len(words) - 5)))
        prints = np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64)
        keys = {(s, int((prints * np.uint64(s)).min())) for s in MIXERS}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def toxic_features(marked: Counter, plain: Counter, n1: int, n0: int) -> set[str]:
    """Features with a share in marked texts far over that in others, by a gain
    in likelihood that none of them would reach by luck."""
    prior, needed = n1 / max(1, n1 + n0), np.log(max(1, len(marked)) / LUCK)
    out = set()
    for f, k1 in marked.items():
        k0 = plain[f]
        if k1 < 3 or np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1)) < LEAST_LIFT:
            continue
        gain = k1 * np.log(k1 / ((k1 + k0) * prior))
        if k0:
            gain += k0 * np.log(k0 / ((k1 + k0) * (1 - prior)))
        if gain >= needed:
            out.add(f)
    return out


def train(rows: list[tuple[str, int]]) -> Model:
    """From (text, mark)."""
    marks = np.array([m for _, m in rows], int)
    base = float(marks.mean()) if len(rows) else 0.0
    if len(set(marks.tolist())) < 2:
        return Model({}, 0.0, np.zeros((2, 2)), 0.0, None, base)
    docs = [t.lower().split() for t, _ in rows]
    apart = _apart(docs)
    short = {t: [sys.intern(f) for f in word_features(t) if f[0] in "wb"] for t in set().union(*docs)}
    others = [i for i in apart if not marks[i]]
    left = [i for i in apart if marks[i]]
    plain = Counter(f for i in others for f in {f for t in set(docs[i]) for f in short[t]})
    toxic: set[str] = set()
    # Each round looks at the marked texts that no toxic feature explains yet.
    for _ in range(ROUNDS):
        count = Counter(f for i in left for f in {f for t in set(docs[i]) for f in short[t]})
        new = toxic_features(count, plain, len(left), len(others)) - toxic
        if not new:
            break
        toxic |= new
        left = [i for i in left if not any(f in toxic for t in docs[i] for f in short[t])]
    toxic_word = {t: any(f in toxic for f in short[t]) for i in np.flatnonzero(marks) for t in set(docs[i])}

    # Windows of a run's length; those with a toxic token first, the rest spread evenly.
    hit, rest = [], []
    for i, words in enumerate(docs):
        for k in range(0, len(words), RUN):
            w = words[k : k + RUN]
            y = [int(bool(marks[i]) and toxic_word.get(t, False)) for t in w]
            (hit if any(y) else rest).append((w, y))
    hit = hit[:: max(1, -(-len(hit) // (WINDOWS // 2)))]
    rest = rest[:: max(1, -(-len(rest) // (WINDOWS - len(hit))))]
    windows = hit + rest
    types = {t: k for k, t in enumerate(sorted({t for w, _ in windows for t in w}))}
    del short, docs, plain, count, toxic_word
    every = {t: [sys.intern(f) for f in word_features(t)] for t in types}
    often = Counter(f for t in types for f in every[t])
    names = {f: k for k, f in enumerate(sorted(f for f, c in often.items() if c > 1 or f[0] == "w"))}
    of_type, of_name = [], []
    for t, k in types.items():
        for f in every[t]:
            if f in names:
                of_type.append(k)
                of_name.append(names[f])
    of_type, of_name = np.array(of_type), np.array(of_name)
    del every, often
    n = len(windows)
    ids = np.full((RUN, n), -1)
    gold = np.zeros((RUN, n))
    for j, (w, y) in enumerate(windows):
        ids[: len(w), j] = [types[t] for t in w]
        gold[: len(w), j] = y
    present = ids >= 0
    flat_ids = ids[present]
    both = present[1:]
    gold_pairs = np.array([
        [((1 - gold[:-1]) * (1 - gold[1:]) * both).sum(), ((1 - gold[:-1]) * gold[1:] * both).sum()],
        [(gold[:-1] * (1 - gold[1:]) * both).sum(), (gold[:-1] * gold[1:] * both).sum()],
    ])
    size = len(names) + 1 + 4
    x, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    x[len(names)] = -4.0
    for step in range(1, STEPS + 1):
        w, bias, trans = x[: len(names)], x[len(names)], x[len(names) + 1 :].reshape(2, 2)
        scores = bias + np.bincount(of_type, w[of_name], len(types))
        e = np.where(present, scores[ids], 0.0)
        m00, m01, m10, m11 = spread(trans, e, present)
        em = np.where(present, np.exp(np.clip(e, -30, 30)), 1.0)
        m00[0], m10[0], m01[0], m11[0] = 1.0, 0.0, 0.0, em[0]  # the first token has no transition
        f0, f1 = np.empty((RUN, n)), np.empty((RUN, n))
        a0 = a1 = np.ones(n)
        for k in range(RUN):
            a0, a1 = a0 * m00[k] + a1 * m10[k], a0 * m01[k] + a1 * m11[k]
            s = a0 + a1
            a0, a1 = a0 / s, a1 / s
            f0[k], f1[k] = a0, a1
        y0 = y1 = np.ones(n)
        post = np.empty((RUN, n))
        pairs = np.zeros((2, 2))
        for k in range(RUN - 1, -1, -1):
            z = f0[k] * y0 + f1[k] * y1
            post[k] = f1[k] * y1 / z
            if k:
                terms = np.array([f0[k - 1] * m00[k] * y0, f0[k - 1] * m01[k] * y1, f1[k - 1] * m10[k] * y0, f1[k - 1] * m11[k] * y1])
                terms = terms / terms.sum(0)
                pairs += (terms * present[k]).sum(1).reshape(2, 2)
            y0, y1 = m00[k] * y0 + m01[k] * y1, m10[k] * y0 + m11[k] * y1
            s = y0 + y1
            y0, y1 = y0 / s, y1 / s
        diff = (post - gold)[present]
        by_type = np.bincount(flat_ids, diff, len(types))
        g = np.concatenate([np.bincount(of_name, by_type[of_type], len(names)), [diff.sum()], (pairs - gold_pairs).ravel()])
        g += 0.05 * x
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        x = x - 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    weights = {f: float(x[k]) for f, k in names.items() if abs(x[k]) > 0.02}
    model = Model(weights, float(x[len(names)]), x[len(names) + 1 :].reshape(2, 2).copy(), 0.0, None, base)
    rows_x = []
    for at in range(0, len(rows), 256):
        rows_x += [evidence(f) for f in model.tag([t for t, _ in rows[at : at + 256]])]
    model.curve = tuple(logistic(np.array(rows_x), marks.astype(float)))
    model.memo = {}
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of about `most` marked and UNMARKED times as many other
    training texts, by hash of the id. One task trains it, since the sample is
    bounded, so that the driver holds the model alone."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max((F.col("toxic") == 1).cast("int")).alias("mark")).where(fold() != 0)
    many = {r.mark: r.n for r in marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(many) < 2:
        return train([("", m) for m in many])
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30))
    upto = {m: int((1 << 30) * min(1.0, most * (1 if m else UNMARKED) / n)) for m, n in many.items()}
    chosen = marked.where(spot < F.when(F.col("mark") == 1, upto[1]).otherwise(upto[0]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(stream(it, "doc_id", "text", "mark"))
        model = pickle.dumps(train([(text, mark) for _, text, mark in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])
        release()

    # About (1 + UNMARKED) * most ids at the very most, so this side is small by construction.
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "mark")
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else train([])


TAGGED = pa.schema(
    [
        ("doc_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64()), ("n_tokens", pa.int64()),
        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))),
    ]
)
TAGGED_DDL = "doc_id long, row long, score double, n_tokens long, spans array<struct<begin:bigint,end:bigint,marginal:double>>"


def offsets(text: str, found: np.ndarray, least: float = 0.5) -> list[dict]:
    """Neighbouring tokens of at least this marginal, as one span each."""
    import re

    out: list[dict] = []
    if not len(found) or found.max() < least:
        return out
    last = -2
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if found[k] >= least:
            if last == k - 1:
                out[-1]["end"] = m.end()
                out[-1]["marginal"] = max(out[-1]["marginal"], float(found[k]))
            else:
                out.append({"begin": m.start(), "end": m.end(), "marginal": float(found[k])})
            last = k
    return out


def some_tokens(text: str) -> int:
    """About how many tokens a text holds; a chain takes a run at least."""
    return max(RUN, len(text) // 6 + 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row (monotonically_increasing_id of the input), score, n_tokens, spans."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value

        def rows() -> Iterator[tuple]:
            some, size = [], 0
            for r in stream(it, "doc_id", "row", "text"):
                some.append(r)
                size += some_tokens(r[2])
                if size >= TOKENS:
                    yield from tagged(some)
                    some, size = [], 0
            yield from tagged(some)

        def tagged(some: list[tuple]) -> Iterator[tuple]:
            for (doc_id, row, text), found in zip(some, m.tag([t for _, _, t in some])):
                yield doc_id, row, m.score(found), len(found), offsets(text, found)

        yield from batches(rows(), TAGGED, lambda r: 64 + 24 * len(r[4]))

    return id_and_text(docs.withColumn("row", F.monotonically_increasing_id()), "row").mapInArrow(run, TAGGED_DDL)


def annotate(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of the input, and the score under this name; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        release()

        def scored(b: pa.RecordBatch, first: int, texts: list[str]) -> pa.RecordBatch:
            scores = pa.array([m.score(found) for found in m.tag(texts)], pa.float64())
            return pa.RecordBatch.from_arrays([*b.slice(first, len(texts)).columns, scores], names=[*b.schema.names, name])

        for b in it:
            at = b.schema.get_field_index("text")
            first, some, size = 0, [], 0
            for k in range(0, b.num_rows, 64):
                for t in b.column(at).slice(k, 64).to_pylist():
                    some.append(t or "")
                    size += some_tokens(some[-1])
                    if size >= TOKENS:
                        yield scored(b, first, some)
                        first, some, size = first + len(some), [], 0
            if some:
                yield scored(b, first, some)
        release()

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, labels, most))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["begin"], s["end"]))).alias("spans"),
    )
