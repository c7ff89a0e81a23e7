"""Joins, dedup, toxicity, mixing, chat and the pipeline."""

import hashlib
import random
from collections import Counter
from itertools import combinations, product

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cairnlog.llm import bpe, chat, components, context_mixing, exact_dedup, golomb, jaccard, media, mixing, packing, parts, secrets, shards, toxicity
from cairnlog.llm.common import id_and_text, materialise, shared_dir
from cairnlog.llm.queries import oracle_sql, queries
from tests.test_queries import TABLES, same_rows

from .conftest import ROWS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same_rows(queries()[name](spark, SF).toPandas(), con.sql(oracle_sql()[name]).df())


# Exact dedup.
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=100, deadline=None)
def test_golomb(values):
    x = np.array(sorted(values), np.uint64)
    assert golomb.decode(golomb.encode(x)).tolist() == x.tolist()


def test_golomb_of_dense_lists_is_small():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 10_000).astype(np.uint64))
    data = golomb.encode(x)
    assert len(data) < 4.2 * len(x) and (golomb.decode(data) == x).all()


def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(odd.repartition(3)).collect()
    norm = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    best = {k: max(v, key=lambda i: (i is not None, i)) for k, v in groups.items()}
    want = Counter((i, best[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for i, t in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_changed_partitions_raise(spark, odd):
    owners = 4
    docs = id_and_text(odd, parts.print_of().alias("print")).coalesce(1)
    sent = parts.write_by_part(exact_dedup._send(docs, owners), "sent", gather=False)
    rows = spark.read.parquet(sent).groupBy("owner").applyInPandas(exact_dedup._answer, "part long, owner long, bitmap binary")
    answers = parts.write_by_part(rows, "answers")
    assert exact_dedup._mark(docs, sent, answers, owners).count() == len(ROWS)
    with pytest.raises(Exception, match="partitions changed"):
        exact_dedup._mark(docs.where("doc_id <> 1"), sent, answers, owners).count()


FILES_AT_ONCE = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def other_splits(spark):
    """A table of many files, and a function that lets later scans deal them
    otherwise, as if executors had gone."""
    path = shared_dir(spark, "files")
    spark.range(400).select("id", F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 350).alias("text"),
                            F.concat(F.lit("s"), F.col("id") % 3).alias("source")).drop("id").repartition(40).write.parquet(path)
    before = {c: spark.conf.get(c, None) for c in FILES_AT_ONCE}

    def change(cores: int, pin: bool = True) -> None:
        spark.conf.set(FILES_AT_ONCE[0], cores)
        spark.conf.set(FILES_AT_ONCE[1], "4096")
        if not pin:
            spark.conf.unset(FILES_AT_ONCE[2])

    spark.conf.unset(FILES_AT_ONCE[2])
    change(8)
    yield spark.read.parquet(path), change
    for c, v in before.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


@pytest.mark.parametrize("cores", [4, 6, 12])
def test_other_splits_between_passes(spark, other_splits, cores):
    """Equal rows where the number of splits is held, and an error, never other rows, where it isn't."""
    docs, change = other_splits
    found = materialise(exact_dedup.exact_dedup(docs).select("row", "print", "kept", "doc_id"), "found")
    want = sorted(r.doc_id for r in found.where("kept").collect())
    n = docs.rdd.getNumPartitions()
    change(cores)
    assert docs.rdd.getNumPartitions() == n
    assert sorted(r.doc_id for r in parts.keep_rows(docs, found, "kept").collect()) == want
    change(cores, pin=False)
    again = spark.read.parquet(docs.inputFiles()[0].rsplit("/", 1)[0])
    assert again.rdd.getNumPartitions() != n
    with pytest.raises(Exception, match="partitions changed"):
        parts.keep_rows(again, found, "kept").collect()


def test_passes_of_other_splits_raise(spark, other_splits, monkeypatch):
    """Each operator that passes twice, with the splits changed behind its first pass."""
    docs, change = other_splits
    monkeypatch.setattr(parts, "steady", lambda s: None)
    for module in (jaccard, exact_dedup, mixing):
        monkeypatch.setattr(module, "steady", lambda s: None)
    sets, sized, send = jaccard.ends, mixing._laid_out, exact_dedup.write_by_part

    def first_pass(f):
        def run(*a, **k):
            out = f(*a, **k)
            change(3, pin=False)
            return out
        return run

    monkeypatch.setattr(jaccard, "ends", first_pass(sets))
    with pytest.raises(Exception, match="partitions changed"):
        jaccard.similar(docs).count()
    change(8, pin=False)
    monkeypatch.setattr(exact_dedup, "write_by_part", first_pass(send))
    with pytest.raises(Exception, match="partitions changed|KeyError"):
        exact_dedup.exact_dedup(docs).count()
    change(8, pin=False)
    monkeypatch.setattr(mixing, "_laid_out", first_pass(sized))
    with pytest.raises(Exception, match="partitions changed"):
        corpus_pipeline.mix_sources(spark, docs, "").collect()


# Jaccard join.
def slow_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if either and 100 * both >= percent * either:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts(seed, n_groups, words, edits):
    r = random.Random(seed)
    out = []
    common = [f"c{k}" for k in range(12)]
    for _ in range(n_groups):
        base = [r.choice("abcdefgh") + str(r.randrange(400)) for _ in range(r.choice(words))]
        at = r.randrange(len(base) + 1)
        base = base[:at] + common * r.randrange(2) + base[at:]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(edits + 1)):
                copy[r.randrange(len(copy))] = str(r.random())
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("n, percent, border, pairs", [(3, 90, None, 2), (5, 80, None, 2), (3, 90, 1, 0), (3, 70, 1, 0), (2, 80, 14, 0)])
def test_jaccard_is_brute_force(spark, monkeypatch, n, percent, border, pairs):
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    if border:
        monkeypatch.setattr(jaccard, "boundary", lambda counts, p: border)
    texts = near_texts(n * percent, 14, (3, 9, 14, 25, 60, 150), 3) + ["", None, "a", "a b", "A b", "x y z", "x  y\tz"]
    root, sizes = slow_components(texts, n, percent)
    docs = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id - 10: r for r in jaccard.similar(docs, n, percent).collect()}
    assert [got[i].component_id - 10 for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert sum(r.stays for r in got.values()) == len(set(root))


@pytest.mark.parametrize("n, percent, words, most", [(3, 90, 200, 4), (5, 80, 150, 5)])
def test_jaccard_of_one_large_group(spark, monkeypatch, n, percent, words, most):
    """Near copies of a text that isn't there itself, and of a second version of
    it: most link, many do so only by way of others, and some with none."""
    monkeypatch.setattr(jaccard, "boundary", lambda counts, p: 1)
    seen = []
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda lists, p: seen.append(across(lists, p)) or seen[-1])
    r = random.Random(words)
    one = [f"w{k}" for k in range(words)]
    two = [*one[: words // 2], *(f"v{k}" for k in range(words // 2, words))]
    texts = []
    for k in range(420):
        copy = list(two if k % 3 == 0 else one)
        for at in r.sample(range(words), r.randrange(1, most + 1)):
            copy[at] = r.choice(["x", "y", f"z{k}{at}"])
        texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    root, _ = slow_components(texts, n, percent)
    assert 10 < len(set(root)) < len(texts) // 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in jaccard.similar(docs, n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert seen[0].count() < len(texts) ** 2 / 10


def test_jaccard_lists_no_differences_that_own_elements_rule_out(spark, monkeypatch):
    """Copies with many words of their own beside copies with one: none of the former can link."""
    monkeypatch.setattr(jaccard, "boundary", lambda counts, p: 1)
    seen, keep = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: (seen.append(keep(df, name)) or seen[-1]) if name == "banded" else keep(df, name))
    r = random.Random(4)
    texts = []
    for k in range(160):
        copy = [f"w{i}" for i in range(150)]
        for at in r.sample(range(1, 24), 1 if k < 30 else 5):
            copy[6 * at] = f"z{k}x{at}"
        texts.append(" ".join(copy))
    root, _ = slow_components(texts, 5, 80)
    assert root == [0] * 30 + list(range(30, 160))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in jaccard.similar(docs, 5, 80).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert seen and sum(x.count() for x in seen) == 0


def test_jaccard_of_odd_rows(spark, odd):
    got = jaccard.similar(odd).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert sum(r.stays for r in got if r.doc_id in (5, 6)) == 1


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    assert got == root
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_subsets_and_costs():
    x = jaccard.shingles("a b c d e f g h i j k l m", 3)
    assert sum(len(h) for h, _ in jaccard.subsets(x, 90)) == jaccard.n_subsets(len(x), 90) == 1 + len(x)
    assert jaccard.boundary({5: 1000}, 90) > 5 and jaccard.boundary({200: 10}, 90) <= 200


# Toxicity.
def test_marginals_by_enumeration():
    r = np.random.default_rng(3)
    trans, start = r.normal(size=(2, 2)), 0.3
    chains = [r.normal(size=n) * 2 for n in (1, 2, 5, 9, 0)]
    long = r.normal(size=200)
    got = toxicity.marginals([*chains, long], trans, start)
    for e, m in zip(chains, got):
        total, on = 0.0, np.zeros(len(e))
        for states in product((0, 1), repeat=len(e)):
            before = None
            w = 0.0
            for k, s in enumerate(states):
                first = np.logaddexp(trans[0, s], start + trans[1, s]) if before is None else trans[before, s]
                w += first + (e[k] if s else 0.0)
                before = s
            total += np.exp(w)
            on += np.exp(w) * np.array(states)
        assert np.allclose(m, on / total)
    assert len(got[-1]) == 200 and np.isfinite(got[-1]).all() and len(got[4]) == 0


def test_toxicity_learns_and_points(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeghiklmnoprstu") for _ in range(r.randrange(2, 8)))
    rows = []
    for i in range(500):
        w = [word() for _ in range(r.randrange(4, 80))]
        mark = int(i % 4 == 0)
        for _ in range(mark * r.randrange(1, 4)):
            w[r.randrange(len(w))] = r.choice(["zorgbad", "quixvile", "zorgful", "quixer"]) + r.choice(["", ",", "."])
        rows.append((i, " ".join(w), mark))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, m) for i, _, m in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, marks).collect()}
    wrong = sum((got[i].score >= 0.5) != bool(m) for i, _, m in rows)
    assert wrong <= 5
    for i, t, m in rows:
        for s in got[i].spans:
            if s.marginal > 0.9 and m:
                assert any(x in t[s.begin : s.end] for x in ("zorg", "quix"))


def test_toxicity_of_odd_rows(spark, odd, labels):
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


# Mixing.
@pytest.mark.parametrize("sizes", [[100, 0, 7], [1, 1, 1000], [5, 5, 5, 5, 5], [0, 0], [10]])
def test_targets(spark, sizes):
    rows = [(None if i == 1 else f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0]))
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
    total, full, target = sum(sizes), set(), {}
    while True:  # as the contract words it: share, stop, share the excess again
        left = total - sum(3 * n for s, n in rows if s in full)
        w = sum(weight[s] for s, _ in rows if s not in full)
        target = {s: 3 * n if s in full else left * weight[s] / w for s, n in rows}
        over = {s for s, n in rows if s not in full and target[s] > 3 * n}
        if not over:
            break
        full |= over
    assert {s: r.target for s, r in got.items()} == pytest.approx(target)
    assert sum(target.values()) == pytest.approx(total)


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(0, 400)), r.choice(["a", "a", "a", "b", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, block_words=64).collect()
    assert all(0 <= x.taken <= 3 * x.size for x in got)
    again = mixing.mix(docs, block_words=64).collect()
    assert Counter((x.doc_id, x.taken) for x in got) == Counter((x.doc_id, x.taken) for x in again)
    for s in ("a", "b", None):
        mine = [x for x in got if x.source == s]
        taken = sum(x.taken for x in mine)
        assert abs(taken - mine[0].target) <= 0.03 * mine[0].target + 5 * 64


def test_schedule_spreads_evenly(spark):
    aims = spark.createDataFrame([("a", 1, 6000.0), ("b", 2, 3000.0), ("c", 3, 1000.0)], "source string, place int, target double")
    rows = mixing.schedule(spark, aims, 10).orderBy("slot").collect()
    for upto in (100, 500, 1000):
        n = Counter(x.place for x in rows[:upto])
        assert all(abs(n[p] - upto * t) <= 8 for p, t in ((1, 0.6), (2, 0.3), (3, 0.1)))
    for p in (1, 2, 3):
        assert [x.rank for x in rows if x.place == p] == list(range(sum(x.place == p for x in rows)))


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ROWS) and all(x.taken <= 3 * x.size for x in got)


def test_pipeline_mix_gives_every_source_its_words(spark):
    sizes = {"a": [100] * 200, "b": [250] * 200, "c": [20] * 3, "d": [7, 13], "e": [30] * 30, "f": [4000, 10, 10], "g": [1]}
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, n) for s, all_ in sizes.items() for n in all_)]
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, "doc_id long, text string, source string"), "sources")
    aims = {r.source: r.target for r in mixing.mix(docs).collect()}
    got, seen = Counter(), Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r.source] += len(r.text.split())
        seen[r.doc_id] += 1
    for s, n in sizes.items():
        assert got[s] > 0 and abs(got[s] - aims[s]) <= max(n) / 2 + 1, (s, got[s], aims[s])
    assert max(seen.values()) <= mixing.MOST


def test_pipeline_mix_keeps_a_source_of_one_long_document(spark):
    rows = [(0, "w " * 50_000, "a"), (1, "w " * 9_000, "b"), (2, "w " * 50_000, "c")]
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, "doc_id long, text string, source string"), "long")
    assert {r.source for r in corpus_pipeline.mix_sources(spark, docs, "").collect()} == {"a", "b", "c"}


def test_pipeline_mix_is_in_the_schedule_s_order(spark, monkeypatch):
    """Every stretch of the mix has the sources by their targets, however the input lies."""
    r = random.Random(9)
    rows = [(k, " ".join(["w"] * r.randrange(20, 400)), s) for k, s in enumerate("a" * 700 + "b" * 900 + "c" * 500)] + [(9999, "w w", "d")]
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), "sources")
    aims = {x.source: x.target for x in mixing.mix(docs).collect()}
    monkeypatch.setattr(corpus_pipeline, "FILE_SLOTS", 200, raising=False)
    got = corpus_pipeline.mix_sources(spark, docs, "")
    mixed = [(x.source, len(x.text.split())) for x in got.collect()]
    whole, seen, total = sum(aims.values()), Counter(), 0
    for k, (s, n) in enumerate(mixed):
        seen[s] += n
        total += n
        assert all(abs(seen[x] - total * aims[x] / whole) <= 5 * 400 for x in "abc"), k
    assert {s for s, _ in mixed} == set("abcd")
    path = shared_dir(spark, "mixed")
    got.write.parquet(path)
    files = Counter(x.f for x in spark.read.parquet(path).selectExpr("input_file_name() AS f").collect())
    assert len(files) > 3 and max(files.values()) < len(mixed) / 2
    assert mixed == [(x.source, len(x.text.split())) for x in corpus_pipeline.mix_sources(spark, docs, "").collect()]


# Chat.
def test_fold_of_events(spark):
    log = [
        (1, 3, 0, "delta", "user", "lo"), (1, 1, 0, "delta", "user", "hel"),
        (1, 4, 1, "delta", "assistant", "bad"), (1, 5, 1, "regenerate", "assistant", None), (1, 6, 1, "delta", None, "good "), (1, 7, 1, "delta", "assistant", "one"),
        (1, 9, 2, "delta", "user", "x"), (1, 10, 2, "edit", "user", "edited"), (1, 11, 2, "delta", "user", "!"), (None, 1, None, "delta", None, None),
        (1, 12, 3, "edit", "user", "AAA"), (1, 12, 3, "edit", "user", "BBB"), (1, 12, 3, "edit", "user", "AAA"), (1, 13, 3, "delta", "user", "."), (1, 13, 3, "delta", "user", "."),
        (1, 14, 4, "edit", "user", "x"), (1, 14, 4, "edit", "user", "x"), (1, 15, 5, "regenerate", "user", None), (1, 15, 5, "edit", "user", "both"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in log], "conv_id long, seq long, turn long, kind string, role string, text string, copy int")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good one"), (1, 2): ("user", "edited!"), (None, None): ("", ""),
                   (1, 3): ("user", "BBB."), (1, 4): ("user", "x"), (1, 5): ("user", "both")}


@pytest.mark.parametrize("text", ["", "\\", "<|im_end|>", "\\b\\p<|", "<\\p", "<|<|", "a\\n\n<", "|>\n<|im_start|>assistant\nx", "é" * 600 + "\\<|"])
def test_chat_round_trip(spark, text):
    rows = [(7, 0, text[:20], text), (7, 1, "assistant", text), (7, 1, "assistant", "again"), (None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold(chat.events_of(table, delta=5)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    said = sorted([text, "again"])
    assert [(t.role, t.text) for t in got[7].turns] == [(text[:20], text), *(("assistant", t) for t in said)]
    assert got[7].loss_text == "".join(said)
    assert got[7].formatted.count("<|im_start|>") == 3 and got[None].turns[0].text == ""


def test_chat_query_has_the_planted_conversation(spark):
    r = queries()["op7_chat"](spark, SF).where("conv_id = -1").first()
    t = "<|im_end|><|im_start|>assistant ok"
    assert (r.n_turns, r.loss_chars) == (2, len(t)) and r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


# All together.
def test_empty_tables(spark, odd, labels):
    none = odd.where("false")
    v = bpe.vocabulary()
    for df in (
        packing.pack(none, v), shards.read_shards(shards.write_shards(none, v, shared_dir(spark, "e"))), secrets.secrets(none), jaccard.similar(none),
        toxicity.toxicity(none, labels), mixing.mix(none), context_mixing.score(none), exact_dedup.exact_dedup(none), media.digest(media.text_media(none)),
        chat.read_back(chat.render(chat.fold(chat.events_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert out.columns == columns
        rows = out.collect()
        assert all(before[r.doc_id] == r for r in rows)
        kept[name] = {r.doc_id for r in rows}
        if name == "exact_dedup":
            best = {}
            for r in before.values():
                k = r.text.encode().lower()
                best[k] = max(best.get(k, -1), r.doc_id)
            assert kept[name] == set(best.values())
        if name == "near_copies":
            order = sorted(before)
            root, _ = slow_components([before[i].text for i in order], 5, 80)
            assert kept[name] == {order[k] for k in set(root)}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept["mixing"]
    assert len({r.sequence_id for r in packed}) == len(packed)


def test_pipeline_stages_of_odd_rows(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "odd")
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
