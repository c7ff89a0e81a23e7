"""Packing, shards, secrets, scoring, media: each row by itself."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnlog.llm import bpe, context_mixing, in_text, media, packing, secrets, shards
from cairnlog.llm.common import documents, filesystem, shared_dir

from .conftest import ROWS

SF = "/root/testdata/sf0.001"
TEXTS = [t or "" for _, t in ROWS]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(bpe.vocabulary())
    return lambda text, end: np.array([*t.encode(text, add_special_tokens=False).ids, end], "<u4")


@given(st.lists(st.text(alphabet="ab é,.!'\n\t  　\x1c\x85s1<|", max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    e = bpe.encoder(bpe.vocabulary())
    plain = Tokenizer.from_file(bpe.vocabulary())
    assert e.ids(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_special_tokens_are_the_library_s(plain):
    e = bpe.Encoder(bpe.vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "word<|endoftext|>\n\n<|endoftext|> it's", "<|endoftext", "x <|im_end|> y"]
    assert [t + np.array([0], "<u4").tobytes() for t in e.ids(texts)] == [plain(t, 0).tobytes() for t in texts]
    assert 50256 in np.frombuffer(e.ids(texts[:1])[0], "<u4")


def test_encoder_starts_its_memo_anew():
    e = bpe.Encoder(bpe.vocabulary(), memo=3)
    for t in ("a b c d e f", "b c d, e", "g h. i"):
        assert e.ids([t, t]) == e.whole([t, t])


def test_letters_are_encoded_once_and_without_the_pattern(monkeypatch):
    """What the time goes to: cuts of letters don't pass the pattern, and no cut is encoded twice."""
    texts = ["Plain words éclat and слова\nof letters words", "words and lines\nof letters"] * 20
    e = bpe.Encoder(bpe.vocabulary())
    want, seen, speller = e.whole(texts), [], e.speller

    class Speller:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return speller.encode_batch_fast(texts, **more)

    e.speller = Speller()
    monkeypatch.setattr(e, "tokenizer", None)
    assert e.ids(texts) == want and e.ids(texts) == want
    # A word at a line's beginning is a cut of its own.
    assert sorted(w for t in seen for w in t.split()) == sorted("Plain words words éclat and слова of letters lines".split())


@given(st.lists(st.text(alphabet="abÀßÿĀɏЀяҁ×÷ªµ,.'\n \xa0\u0345", max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_letters_that_stand_between_line_breaks(texts):
    e = bpe.encoder(bpe.vocabulary())
    assert e.apart and e.ids(texts) == e.whole(texts)
    other = bpe.Encoder(bpe.vocabulary())
    other.apart = False
    assert other.ids(texts) == other.whole(texts)


def test_rows_are_encoded_together():
    rows = [(k, "word " * 5) for k in range(2 * bpe.TEXTS)] + [(-1, "x" * bpe.TEXT_CHARS), (-2, "")]
    held = list(bpe.together(iter(rows)))
    assert sum(held, []) == rows and [len(h) for h in held] == [bpe.TEXTS, bpe.TEXTS, 1, 1]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_lengths(n):
    got = packing.lengths(n)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got) and got == sorted(got, reverse=True)
    assert len([x for x in got if x < 1024]) == len({x for x in got if x < 1024})


def test_packing(spark, odd, plain):
    got = packing.pack(odd, bpe.vocabulary()).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    whole = Counter()
    by = {}
    for r in sorted(got, key=lambda r: (r.start,)):
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (doc_id, n), pieces in by.items():
        copies = Counter(r.start for r in pieces)
        assert len(set(copies.values())) == 1 and sum(r.length for r in pieces) == n * copies[0]
        for c in range(copies[0]):
            mine = [[r for r in pieces if r.start == s][c] for s in sorted(copies)]
            assert all(len(r.tokens) == 4 * r.length for r in mine)
            whole[doc_id, b"".join(r.tokens for r in mine)] += 1
    assert whole == Counter((i, plain(t or "", 0).tobytes()) for i, t in ROWS)
    with pytest.raises(ValueError):
        packing.pack(odd, bpe.vocabulary(), longest=1000)


def test_buckets_are_rectangular(spark, odd, tmp_path):
    packing.write_buckets(packing.pack(odd, bpe.vocabulary()), str(tmp_path / "b"))
    for r in spark.read.parquet(str(tmp_path / "b")).collect():
        assert len(r.tokens) == 4 * r.length


def test_shards(spark, odd, plain):
    folder = shared_dir(spark, "test")
    manifest = shards.write_shards(odd, bpe.vocabulary(), folder)
    got = shards.read_shards(manifest).collect()
    got.sort(key=lambda r: (r.start))
    assert Counter((r.doc_id, bytes(r.tokens)) for r in got) == Counter((i, plain(t or "", 2).tobytes()) for i, t in ROWS)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    for m in manifest.collect():
        files, at = filesystem(m.path)
        with files.open_input_file(at) as f:
            reader = shards.Reader(f)
            here = [i for i, _, _ in reader]
            assert (reader.docs, len(here)) == (m.docs, m.docs)
            for i in {1, 5, None, -4, 99, 12345}:
                found = reader.get(i)
                assert len(found) == here.count(i)
                assert all(x.tobytes() in {plain(t or "", 2).astype("<u2").tobytes() for j, t in ROWS if j == i} for x in found)


def test_shard_of_many_blocks_and_damage(tmp_path):
    import io

    import pyarrow as pa

    out = io.BytesIO()
    w = shards.Writer(out, 4)
    rows = [(i // 2 - 50, np.arange(i % 700 * 20, dtype="<u4")) for i in range(400)]
    for i, ids in rows:
        w.add(i, ids)
    w.close()
    reader = shards.Reader(pa.BufferReader(out.getvalue()))
    assert len(reader.index) > 3
    assert [(i, ids.tolist()) for i, _, ids in reader] == [(i, ids.tolist()) for i, ids in rows]
    assert [b for _, b, _ in reader] == np.cumsum([0, *(len(x) for _, x in rows)])[:-1].tolist()
    assert [x.tolist() for x in reader.get(7)] == [x.tolist() for i, x in rows if i == 7]
    assert sum(reader.maybe(i) for i in range(10_000, 11_000)) < 50
    bad = bytearray(out.getvalue())
    bad[10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(shards.Reader(pa.BufferReader(bytes(bad))))
    with pytest.raises(ValueError, match="not a shard"):
        shards.Reader(pa.BufferReader(bytes(200)))


def slow_spans(text):
    out = []
    pattern = re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for kind, p, good in (
        (0, pattern, lambda m: len(m[2]) >= 6), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in p.finditer(text) if good(m)]
    return sorted(out)


@given(st.text(alphabet="tokenTOKEN:= \"'apikeyAKIA01f_éK", max_size=80))
@settings(max_examples=200, deadline=None)
def test_base_spans(text):
    assert secrets.base_spans(text) == slow_spans(text)
    assert secrets.base_spans("é" + text + "0" * 24) == slow_spans("é" + text + "0" * 24)


def test_base_spans_where_a_failing_match_eats_the_next():
    for t in ("token=token: abcdefgh", "API_KEY:'sEcret=abc", "AKIAAKIA" + "B" * 12, "AKIA" + "C" * 15, "Token = abcdef"):
        assert secrets.base_spans(t) == slow_spans(t)


def test_secret_scan(spark, odd):
    net = secrets.train([TEXTS[9]] * 20)
    got = {r.doc_id: r.spans for r in secrets.scan(odd.select("doc_id", "text").fillna("", ["text"]), net).collect()}
    assert [s.kind for s in got[9]] == ["assign", "access", "hex"] and got[2] == [] == got[3]
    keys = "my ghp_abcdEFGH1234ijklMNOP5678qrstUVWX90ab key"
    assert [s["kind"] for s in secrets.scan_texts([keys], net)[0]] == ["model"]
    for clean in ("mail foo.27@mail4.example.com it", "card 4410548271619283 is", "in 2024-01-02T03-00 we"):
        assert secrets.scan_texts([clean], net)[0] == []
    held = secrets.examples(400, seed=99)
    found = [any(s["kind"] == "model" for s in f) or bool(secrets.base_spans(t)) for (t, _), f in zip(held, secrets.scan_texts([t for t, _ in held], net))]
    marks = [bool(m) for _, m in held]
    hits = sum(f and m for f, m in zip(found, marks))
    assert hits >= 0.95 * sum(marks) and sum(f and not m for f, m in zip(found, marks)) <= 0.05 * len(marks)


def test_long_candidates_are_seen_whole():
    got = secrets.windows("x " + "a1" * 200 + " y", 2, 402)
    assert got[-1][0].endswith(" y") and all(len(s) <= secrets.LENGTH for s, _, _ in got)
    seen = sum(b - a for _, a, b in got)
    assert seen >= 400


def test_keys_without_digits_are_candidates():
    for key in ("sk_live_AbCdEfGhIjKlMnOpQrStUvWx", "AbCdEfGh+IjKlMnOp/QrStUvWx==", "AbCdEfGhIjKlMnOpQrStUvWx"):
        assert secrets.candidates(f"x {key} y") == [(2, 2 + len(key))]
    for plain in ("one-two-three-four-five-six", "ONE_TWO_THREE_FOUR_FIVE", "Short-Mixed-Case"):
        assert secrets.candidates(plain) == []


def test_threshold_meets_the_recall_under_one_half(monkeypatch):
    monkeypatch.setattr(secrets.Network, "score", lambda self, shown: np.full(len(shown), 0.3))
    assert secrets.train([], most=300).threshold == 0.3


def test_threshold_holds_the_recall():
    x = np.random.default_rng(1).random(1000)
    for recall in (0.9, 0.95, 0.995, 1.0):
        t = secrets.highest(x, recall)
        assert (x >= t).mean() >= recall and (x > t).mean() < recall + 1e-9
    net = secrets.train([TEXTS[9]] * 20)
    assert net.measured["windows"] > 100 and net.measured["recall"] >= 0.95 and net.measured["precision"] >= 0.9


def test_network_learns_from_all_rows(spark, monkeypatch):
    """More documents and findings than any sample had, in one shard or many."""
    keys = [hashlib.sha256(str(k).encode()).hexdigest()[:30] for k in range(7000)]
    texts = [f"at {k} or mail.{n}@a{n}.example.com" for n, k in enumerate(keys)]
    tenths = [[t for _, _, t in secrets.dealt(x, None)] for x in texts]
    made = [t for x, m in secrets.examples(100) for _, _, t in secrets.dealt(x, m)]
    assert secrets.train(texts, 300).measured["windows"] == sum(x.count(9) for x in tenths) + made.count(9)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:50])], "doc_id long, text string").repartition(3)
    few, one = docs.where("doc_id < 400"), secrets.train(texts[:400], 300)
    got = secrets.train_on(few, 300)
    assert got.measured == one.measured and got.threshold == pytest.approx(one.threshold, rel=1e-6)
    assert all(got.p[k] == pytest.approx(one.p[k], rel=1e-6, abs=1e-9) for k in one.p)
    monkeypatch.setattr(secrets, "SHARD", 4000)
    net = secrets.train_on(docs, 300)
    assert net.measured["windows"] > sum(x.count(9) for x in tenths) and net.measured["recall"] >= 0.98 and net.measured["precision"] >= 0.98


def test_windows_know_their_piece():
    rows = secrets.labelled([("x " + "a1" * 200 + " y", 1), ("plain", 0), ("k AbCdEfGhIjKlMnOpQrStUvWx", 0)])
    assert {k for _, _, k in rows} == {0, 2} and {m for _, m, k in rows if k == 0} == {1}


def test_every_candidate_is_scored():
    class Counting(secrets.Network):
        def score(self, shown):
            self.shown = shown
            return np.ones(len(shown))

    net = Counting()
    found = secrets.scan_texts(["token=abcdef123456 and ghp_abcdEFGH1234ijklMNOP5678qrst"], net)[0]
    assert len(net.shown) == 2 and [s["kind"] for s in found] == ["assign", "model"]


def test_network_gradients():
    net = secrets.Network()
    shown = [w for t, _ in secrets.examples(6) for a, b in secrets.candidates(t) for w in secrets.windows(t, a, b)]
    x, inside = secrets.as_indices(shown)
    y = np.arange(len(x)) % 2

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, inside)["z"]))
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    g = net.gradients(x, inside, y)
    for name, at in (("conv", (3, 2)), ("emb", (10, 1)), ("hid", (20, 3)), ("out", (1,)), ("cb", (4,)), ("ob", (0,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_context_mixing_base_and_edges(spark, odd):
    got = context_mixing.score(odd).collect()
    learnt = Counter()
    for i, t in ROWS:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            learnt.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(learnt.values()), len(learnt)
    want = Counter()
    for i, t in ROWS:
        words = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[i, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(words), sum(learnt[w] > 0 for w in words), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) and 0 < r.bits_per_byte < 20 for r in got)


def test_mixer_is_a_probability():
    units = [context_mixing.unit(w) for w in (b"the", b"then", b"of", b"a")]
    counts = context_mixing.count_bits(units, np.array([50, 20, 30, 9]))
    m = context_mixing.Mixer(counts)
    m.learn(units * 50, counts)
    for head in (b"", b"th"):
        whole = m.score([head]) if head else np.zeros(1)
        nxt = m.score([head + bytes([b]) for b in range(256)])
        assert (10 ** (nxt - whole)).sum() == pytest.approx(1.0, abs=1e-6)
    assert m.score([b"the "])[0] > m.score([b"zzz "])[0] + 2


def test_bit_counts_are_exact():
    one = context_mixing.count_bits([b"ab ", b"ac "], np.array([3, 4]))
    assert one.sum() == context_mixing.ORDERS * 8 * 3 * 7


def test_words_that_begin_alike_share_their_bytes():
    units = [context_mixing.unit(w) for w in (b"then", b"the", b"a", b"thesis", b"and", b"", b"then")]
    times = np.array([5, 20, 3, 2, 7, 4, 1])
    c = context_mixing.count_bits(units, times)
    begun = Counter()
    for u, n in zip(units, times.tolist()):
        begun.update({u[: k + 1]: n for k in range(len(u))})
    assert len(c.times) == len(begun) and sorted(c.times.tolist()) == sorted(begun.values())
    assert c.at.shape == (context_mixing.ORDERS, len(begun))
    # What they give is what each unit gives by itself.
    m = context_mixing.Mixer(c)
    assert m.score(units) == pytest.approx([m.score([u])[0] for u in units], rel=1e-6)
    found = c.paths_of(c)
    for last in (False, True):
        each = [context_mixing.Counts([u], np.array([n])) for u, n in zip(units, times)]
        apart = sum(m.sums(x, c.paths_of(x), last) for x in each)
        assert m.sums(c, found, last) == pytest.approx(apart, rel=1e-4, abs=1e-3)


@given(st.lists(st.text(alphabet="aAÉéſK \n\t\x0b\x0c\r\x1c\x85\xa0\u3000.", max_size=20), max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_of_texts(texts):
    words, n = context_mixing.words_of(pa.array(["x", *texts], pa.string())[1:])
    want = [t.encode().lower().split() for t in texts]
    assert words.to_pylist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    assert len(words.dictionary) == len(set(sum(want, [])))


@pytest.mark.parametrize("dealt", [[7], [1] * 7, [3, 0, 4], [2, 5]])
def test_blocks_follow_the_rows_however_they_come(monkeypatch, dealt):
    """Both passes must see the same blocks: the row that fills one is its last."""
    monkeypatch.setattr(context_mixing, "BLOCK_BYTES", 10)
    monkeypatch.setattr(context_mixing, "SLICE_CHARS", 4)
    texts = ["", "abc", "é" * 7, "", "x" * 50, "yz", ""]
    ends = np.cumsum([0, *dealt])
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[a:b], pa.string())}) for a, b in zip(ends, ends[1:])]
    got = [(k, t) for k, b in context_mixing.by_block(iter(batches)) for t in b.column("text").to_pylist()]
    assert got == list(zip([0, 0, 0, 1, 1, 2, 2], texts))


def test_counts_are_kept_for_the_passes(tmp_path):
    """The passes read what they need of a block's counts, they don't make it again."""
    units = [context_mixing.unit(w) for w in (b"then", b"the", b"a", b"thesis", b"and", b"", b"then")]
    c = context_mixing.count_bits(units, np.array([5, 20, 3, 2, 7, 4, 0]))
    c.keep(f"file://{tmp_path}/0", 3)
    c.keep(f"file://{tmp_path}/0", 4)
    assert [f.name for f in tmp_path.iterdir()] == ["0"]
    kept, found, m = context_mixing.Counts.kept(f"file://{tmp_path}/0"), c.paths_of(c), context_mixing.Mixer(c)
    for last in (False, True):
        assert (m.sums(kept, found, last) == m.sums(c, found, last)).all()
    assert (m.score_found(kept, found) == m.score_found(c, found)).all()


def test_mixer_learns_from_all_training_rows(spark):
    """A long text alone mustn't train the mixer because its id is the lowest."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    long, short = "abcd ef " * 150_000, [f"other words {k} of their own {k * k}" for k in range(20)]

    def scores(texts):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        return {texts[ids.index(r.doc_id)]: r.score for r in context_mixing.score(docs).collect()}

    first, last = scores([long, *short]), scores([*short, long])
    assert first == pytest.approx(last, rel=1e-6)


def test_context_counts_are_exact_at_any_size(spark, monkeypatch):
    """Rare words' contexts keep their own counts beside many others, and the split doesn't matter."""
    r = np.random.default_rng(4)
    words = sorted({bytes(w) for w in r.integers(97, 123, (60_000, 9), np.uint8)})
    counts = context_mixing.count_bits([context_mixing.unit(w) for w in words], np.ones(len(words), np.int64))
    asked = context_mixing.count_bits([b"zebra9x "], np.array([0]))
    found = counts.paths_of(asked)[:, asked.at[context_mixing.Mixer.WORD]]
    assert found[0].tolist() == [sum(w.startswith(b"zebra9x "[:k]) for w in words) for k in range(8)]

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).select("doc_id", "text").localCheckpoint()
    whole = {r.doc_id: r.score for r in context_mixing.score(docs).collect()}
    monkeypatch.setattr(context_mixing, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(context_mixing, "RANGE_KEYS", 50_000)
    assert {r.doc_id: r.score for r in context_mixing.score(docs).collect()} == pytest.approx(whole, rel=1e-6)


def test_media_round_trip(spark, odd):
    stored = media.text_media(odd).collect()
    by = Counter()
    for r in stored:
        x = media.grey(media.decode(r.media))
        by[r.doc_id, r.n_bytes, x.tobytes()] += 1
    assert by == Counter((i, len((t or "").encode()), media.payload(t or "")) for i, t in ROWS)
    assert media.payload("") == bytes(64) and len(media.payload("x" * 64)) == 64
    got = media.digest(media.text_media(odd)).collect()
    for r in got:
        data = media.payload(next(t or "" for i, t in ROWS if i == r.doc_id))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
    a, b = (r for r in got if r.doc_id == 5)
    assert a == b


def test_netpbm_and_bmp():
    x = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    ppm = b"P6 # a comment\n7 5\n# another\n255\n" + x.tobytes()
    assert (media.decode(ppm) == x).all()
    ascii_ = b"P3\n7 5\n255\n" + " ".join(map(str, x.ravel())).encode()
    assert (media.decode(ascii_) == x).all()
    assert media.decode(b"P1\n3 2\n101\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 3 1 15\n0 15 7").tolist() == [[0, 255, 119]] == media.decode(b"P5 3 1 15\n\x00\x0f\x07").tolist()
    g = x[..., 0]
    assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(g)) == g).all()
    row = np.zeros((5, 24), np.uint8)
    row[:, :21] = x[::-1, :, ::-1].reshape(5, 21)
    import struct

    bmp = struct.pack("<2sIHHI", b"BM", 54 + row.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, row.size, 0, 0, 0, 0) + row.tobytes()
    assert (media.decode(bmp) == x).all()


def test_bad_media_is_a_row(spark):
    df = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"P5\n9 9\n255\nshort"), (4, b"P5\n2 1\n255\nab"), (5, b"P5\n1 1\n65535\nab"),
                                (6, b"P2 1 1 255\n300"), (7, b"P2 1 1 255\n-4"), (8, b"P5 1 1 9\n\xff"), (9, b"P2 99999999999 99999999999 255\n1"), (10, b"BM" + bytes(60))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.features(df).collect()}
    assert all(got[i].error and got[i].dhash is None for i in (1, 2, 3, 5, 6, 7, 8, 9, 10)) and got[4].error is None
    assert np.load(__import__("io").BytesIO(got[4].tile_npy)).shape == (media.TILE, media.TILE)


@pytest.mark.parametrize("shape, to", [((13, 7), (5, 3)), ((4, 4), (8, 9)), ((64, 64), (8, 8)), ((1, 1), (3, 2))])
def test_area_resize(shape, to):
    x = np.random.default_rng(2).random(shape)
    got = media.area_resize(x, *to)

    def weights(n, m):
        w = np.zeros((m, n))
        for i in range(m):
            for j in range(n):
                w[i, j] = max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j))
        return w / (n / m)

    assert np.allclose(got, weights(shape[0], to[0]) @ x @ weights(shape[1], to[1]).T)


@pytest.mark.parametrize("name", ["op1_packing", "op2_token_shards", "op10_media"])
def test_row_queries_keep_every_document(spark, name):
    from cairnlog.llm.queries import queries

    n = documents(spark, SF).count()
    got = queries()[name](spark, SF)
    assert got.select("doc_id").distinct().count() == n


# In-text mixing.
def slow_in_text(ids, logp):
    """One text, word by word and bit by bit, from what came before alone."""
    k, total, told = in_text, 0.0, []
    counters, cells, weights, blocks = {}, {}, {}, [[]]
    coded = 0
    asked_at = [{}, {}]
    for t, w in enumerate(ids):
        run = 0
        while run < t and told[t - 1 - run]:
            run += 1
        r = min(run.bit_length(), 4)
        hit_any, ruled = False, None
        for kind in (0, 1):
            wide = 2 - kind
            earlier = [u for u in range(wide, t) if ids[u - wide : u] == ids[t - wide : t]] if t >= wide else []
            if kind == 1 and t >= 1:
                earlier = [u for u in range(1, t) if ids[u - 1] == ids[t - 1]]
            if not earlier or hit_any:
                continue
            word = ids[earlier[-1]]
            if kind == 1 and word == ruled:
                continue
            ruled = word
            bit = int(word == w)
            went = asked_at[kind].get(earlier[-1], 0)
            likely = int(min(max(-2 * logp[earlier[-1]], 0), 15))
            keys = [(0, kind, r, min(len(earlier), 3), went), (1, kind, likely, r > 0), (2, kind, tuple(ids[t - wide : t]))]
            x = []
            for key in keys:
                n, ones = counters.get(key, (0, 0))
                x.append(math.log((p := (ones + k.STRENGTH * k.START[r]) / (n + k.STRENGTH)) / (1 - p)))
            g = (kind, r > 0)
            if (coded // k.FIRST_BLOCK).bit_length() > len(blocks) - 1:
                new = {}
                for gate in {b[0] for b in blocks[-1]}:
                    for j in range(3):
                        mine = [b for b in blocks[-1] if b[0] == gate]
                        slope = sum((b[2] - b[3]) * b[1][j] for b in mine)
                        step = slope / (sum(b[1][j] ** 2 for b in mine) + 8) / 3
                        new[gate, j] = min(max(weights.get((gate, j), k.WEIGHT) + step, 0), 2)
                weights.update(new)
                blocks.append([])
            z = sum(weights.get((g, j), k.WEIGHT) * x[j] for j in range(3))
            p = 1 / (1 + math.exp(-min(max(z, -9), 9)))
            blocks[-1].append((g, x, bit, p))
            coded += 1
            cell = (kind, int(min(max((math.log(p / (1 - p)) + 8) * (k.CELLS / 16), 0), k.CELLS - 1)))
            n, ones = cells.get(cell, (0, 0))
            q = (p + (ones + k.MAP_STRENGTH * p) / (n + k.MAP_STRENGTH)) / 2
            total += math.log10(q if bit else 1 - q)
            for key in keys:
                n1, o1 = counters.get(key, (0, 0))
                counters[key] = (n1 + 1, o1 + bit)
            cells[cell] = (n + 1, ones + bit)
            asked_at[kind][t] = 1 + bit
            hit_any = hit_any or bool(bit)
        told.append(hit_any)
        total += 0.0 if hit_any else logp[t]
    return total


def in_texts(seed):
    r = np.random.default_rng(seed)
    texts = []
    for k in range(12):
        ids = r.integers(0, (2, 3, 8, 60)[k % 4], int(r.integers(0, 130))).tolist()
        texts.append([*(ids[: len(ids) // 3] * 3 if k % 3 == 0 else ids), -1])
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_in_text_mixing_is_bit_by_bit(seed):
    texts = in_texts(seed)
    spell = {i: -0.3 - (i % 7) / 2 for i in range(-1, 60)}
    ids = np.concatenate([np.array(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = in_text.score(ids, doc, np.array([spell[i] for i in ids.tolist()]), len(texts))
    want = [slow_in_text(t, [spell[i] for i in t]) for t in texts]
    assert np.allclose(got, want, atol=1e-9), list(zip(got, want))


def test_in_text_mixing_is_a_probability():
    """Over all texts of two words up to a length, with the end never told apart, probabilities add up to at most 1."""
    from itertools import product

    total = 0.0
    texts = [[*t, -1] for n in range(9) for t in product((0, 1), repeat=n)]
    logp = {0: math.log10(0.5), 1: math.log10(0.3), -1: math.log10(0.2)}
    ids = np.concatenate([np.array(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    total = (10.0 ** in_text.score(ids, doc, np.array([logp[i] for i in ids.tolist()]), len(texts))).sum()
    assert 0.3 < total <= 1


def test_in_text_mixing_sees_order_and_repeats():
    r = np.random.default_rng(4)
    line = r.integers(0, 500, 40)
    lines, mixed = np.append(np.tile(line, 10), -1), np.append(r.permutation(np.tile(line, 10)), -1)
    score = lambda ids: in_text.score(ids, np.zeros(len(ids), np.int64), np.full(len(ids), -3.0), 1)[0]
    assert score(lines) > 0.3 * score(mixed)
