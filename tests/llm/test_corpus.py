"""The corpus operators against plain versions, and on awkward tables."""

import glob
import hashlib
import json
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from locusframe.llm import audio, bpe, chat, common, components, jaccard, langid, mixing, queries, shards, suffixes, toxicity, vectors
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PASSAGE = "this passage of well over fifty bytes stands in several of the texts, word for word"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, slot int, rank int, sign string, row int, gram int, _b int, vec int"


def table(spark, rows):
    """Documents with more columns than asked for, some named like inner ones."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "k", 1, 2, "s", 3, 4, 5, 6) for i, t, lang, src in rows], DOCS)


def awkward():
    rng = random.Random(0)
    words = ["alpha", "bête", "gamma", "der", "Ω", "x1", "o'clock", "we'll", "  ", "\n\n", "日本語", "fin."]
    long = " ".join(rng.choice(words) for _ in range(4000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "hi", "en", "a"), (4, long, "fr", "b"), (5, long, "fr", "b"), (6, long[:-9] + " changed end", None, "b")]
    rows += [(7, "   \t\n ", "en", ""), (8, f"some words before. {PASSAGE} after", "en", "a"), (9, f"{PASSAGE} others follow é", "de", "a"), (10, "12 34 !! ''s 't", "en", "a")]
    rows += [(11, "x" * 300, "en", "c"), (12, "x" * 300 + "y", "en", "c"), (13, "hi", "en", "a"), (None, "no id here at all", "en", "a"), (3, "hi", "en", "a"), (14, "a b c d e f g h", "en", "a"), (15, "A B c d E f g h", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward())


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_empty_tables(spark, empty):
    model = toxicity.Model()
    assert mixing.mix(empty, {}).count() == 0
    assert bpe.bpe(empty, RANKS).count() == 0
    assert audio.digest(audio.features(empty)).count() == 0
    assert suffixes.dedup(empty).count() == 0
    assert langid.learn(empty) is None and langid.predict(empty, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(empty, labels) == model and toxicity.score(empty, model).count() == 0
    assert jaccard.join(empty).count() == 0
    assert shards.interleave(empty).count() == 0
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.link(chat.events_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), {}).count() == 0


# 1


def same_rows(a, b):
    cols = sorted(a.columns)
    norm = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).astype(str).itertuples(index=False, name=None)))
    return norm(a) == norm(b)


@pytest.mark.parametrize("share, epochs", [((1, 2), 4), ((3, 1), 4), ((1, 10), 1), ((9, 1), 3)])
def test_mixing_equals_sql(sample, share, epochs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = mixing.mix(sample, queries.WEIGHTS, share, epochs).toPandas()
    assert same_rows(got, con.sql(mixing.oracle(queries.WEIGHTS, share, epochs)).df())


def test_mixing_awkward(docs, spark):
    got = mixing.mix(docs, {"lang": {"en": 3}}, (1, 1), 4)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(mixing.oracle({"lang": {"en": 3}}, (1, 1), 4)).df()
    assert same_rows(got.toPandas().astype({"doc_id": "Int64"}), want)
    assert set(mixing.mixed(docs, {}, (1, 1)).columns) == set(docs.columns)


def fill(children, amount):
    """{name: share} by raising one ratio until the amount is spent; children: {name: (cap, weight)}."""
    out, left = {}, dict(children)
    while left:
        ratio = amount / sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if c <= ratio * w]
        if not full:
            return out | {k: ratio * w for k, (_, w) in left.items()}
        for k in full:
            out[k] = left.pop(k)[0]
            amount -= out[k]
    return out


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r.source: r.amount for r in mixing.quotas(leaves, {}, (400, 3010), 1).collect()}
    top = fill({"a": (2010, 1), "b": (1000, 1)}, 400)
    lang = fill({"x": (1010, 1), "y": (1000, 1)}, top["a"])
    assert got == {k: int(v) for k, v in (fill({"1": (10, 1), "2": (1000, 1)}, lang["x"]) | {"3": lang["y"], "4": top["b"]}).items()}


# 2


def test_bpe_equals_tiktoken(docs, monkeypatch):
    ranks = bpe.load_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe(docs, RANKS).collect()
    assert len(got) == docs.count()
    want = sorted((hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(enc.encode_ordinary(t or ""))) for _, t, _, _ in awkward())
    assert sorted((r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in got) == want


def test_split_equals_pattern():
    import regex

    rng = random.Random(2)
    alphabet = "ab é'sLl re9½ \t\n  Ω!'日́😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    words, _, index, counts = bpe.split_batch([t.encode() for t in texts], bpe.classes(bpe.class_runs()))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert [words[i].decode() for i in index[at : at + n]] == regex.findall(public_tokenizers.PATTERN, t)
        at += n


def test_words_of_any_length(spark):
    """One path for 1 to 5,000 bytes, and letters newer than this Python's tables."""
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    words = ["e", "the", "x" * 49, "e" * 5000, "ab" * 700, "thereintothe" * 50, "Ω" * 90, "日本語の" * 30, "aaab" * 40, "=" * 999, " " * 200]
    words += ["".join(rng.choice("etaoinsr") for _ in range(n)) for n in (47, 48, 50, 600, 3000)]
    words += ["a\u1c89b \U00010d4a1 c", "\u1c89", "x \U00010d4a\u1c89 9\u1c89"]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe(rows, RANKS).collect()}
    for i, w in enumerate(words):
        ids = enc.encode_ordinary(w)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(w.encode()).hexdigest()), w[:30]


def test_fold_starts_from_ranks_of_byte_pairs(spark):
    """The ranks of a word's first pairs are looked up for a whole batch; the fold replaces few of them."""
    ranks = bpe.load_ranks(RANKS)
    rng = random.Random(5)
    words = [b"e", b"th", b"\xc3", b"aaaaa", b" the", b"x" * 64, b"x" * 65, "日本語".encode() * 9]
    words += ["".join(rng.choice("etaoinsr é'") for _ in range(rng.randint(1, 70))).encode() for _ in range(300)]
    mask = np.arange(len(words)) % 7 == 4
    states = bpe.start_states(words, bpe.first_entries(RANKS), mask)
    assert [s is None for s in states.to_pylist()] == mask.tolist()
    for w, state in zip(words, states.to_pylist(), strict=True):
        if state is not None:
            assert [x % bpe.ID for x in state] == [ranks[bytes([b])] for b in w] and state[-1] >= bpe.LAST
            got = [x // bpe.ID if x < bpe.NONE * bpe.ID else None for x in state[:-1]]
            assert got == [ranks.get(w[i : i + 2]) for i in range(len(w) - 1)]
    rows = spark.createDataFrame(pa.table({"word": pa.array(words, pa.binary()), "state": states}))
    out = bpe.with_constants(rows, RANKS, "pairs", "shift").select("word", bpe.encode_word(F.col("state")).alias("ids")).collect()
    assert len(out) == len(words)
    assert all((r.ids is None) == m and (m or r.ids == bpe.merges(bytes(r.word), ranks)) for r, m in zip(out, mask, strict=True))


def test_ranks_that_merges_do_not_reach(tmp_path):
    import base64

    lines = [(bytes([b]), b) for b in range(256)] + [(b"abcd", 256)]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(p).decode()} {r}\n" for p, r in lines))
    with pytest.raises(ValueError, match="own merges"):
        bpe.load_ranks(str(tmp_path / "ranks"))


# 3


def test_audio(docs):
    got = audio.features(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, []).append(r)
    texts = [t or "" for _, t, _, _ in awkward()]
    assert sorted(r.payload_sha256 for r in got) == sorted(hashlib.sha256(audio.pack(t.encode())).hexdigest() for t in texts)
    for rows in by.values():
        assert len({(bytes(r.tensors), tuple(r.seg_from)) for r in rows}) == 1
        r = rows[0]
        found = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        tensors = found.column("log_mel").combine_chunks().to_numpy_ndarray()
        assert tensors.shape[1:] == audio.SHAPE and r.payload_bytes % 192 == 0 and r.media_bytes == r.payload_bytes + 44
        assert np.all(np.array(found.column("stop_s")) > np.array(found.column("start_s")))


def test_resampling_is_the_plain_convolution():
    x = np.random.default_rng(0).normal(size=192)
    even, odd, _, _ = audio.tables()
    h = np.empty(2 * audio.TAPS)
    h[0::2], h[1::2] = even[::-1], odd[::-1]
    up = np.zeros(2 * len(x))
    up[0::2] = x
    want = np.convolve(up, h)[: 2 * len(x)][::3]
    assert np.allclose(audio.resample(x), want)


def test_hysteresis():
    e = np.array([0, 5, 0.5, -0.5, 5, -5, 0.5, -5, -5.5])
    level, on, want = e - e.mean(), False, []
    for v in level:
        on = True if v > audio.OPEN_DB else False if v < audio.CLOSE_DB else on
        want.append(on)
    got = np.zeros(len(e), bool)
    for a, b in audio.segments(e):
        got[a:b] = True
    assert got.tolist() == want


# 4


def unique_ids(rows):
    return [r for r in rows if r[0] is not None and r[0] != 3]


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffixes(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    want = brute.cut_repeats({i: (t or "").encode() for i, t, _, _ in unique_ids(awkward())})
    got = [r for r in suffixes.dedup(docs).collect()]
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in want:
            assert ([tuple(s) for s in r.spans], bytes(r.kept)) == want[r.doc_id]
            assert r.n_bytes - r.n_removed == len(r.kept) and r.n_spans == len(r.spans)
        else:
            assert r.n_removed == 0


def test_hashes_of_slices_fill_the_bitmap_evenly():
    """The least of 31 hashes is small: as such, nineteen of twenty grams share an eighth of the bits."""
    raw = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    h = suffixes.slices(raw, np.array([len(raw)]))[0]
    share = np.bincount((h >> np.uint64(61)).astype(np.int64), minlength=8) / len(h)
    assert len(h) > 10_000 and share.max() < 0.14


@pytest.mark.parametrize("most", [2, 1 << 21])
def test_copies_of_texts_are_not_sent(spark, monkeypatch, most):
    """Of equal texts those of the smallest id are sent; the others lose all, told or not."""
    monkeypatch.setattr(suffixes, "COPIES", most)
    texts = {5: PASSAGE * 3, 7: PASSAGE * 3, 9: PASSAGE * 3, 2: "before it " + PASSAGE, 8: "x" * 80, 11: "short", 12: "short", 13: "y" * 50, 14: "y" * 50}
    docs = spark.createDataFrame([*texts.items(), (5, PASSAGE * 3), (7, "another text of the id that is longer than fifty bytes by far"), (None, PASSAGE * 3)], "doc_id long, text string")
    got = suffixes.dedup(docs).collect()
    want = brute.cut_repeats({i: t.encode() for i, t in texts.items()})
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None or r.kept.startswith(b"another"):
            assert r.n_removed == 0
        else:
            assert ([tuple(s) for s in r.spans], bytes(r.kept)) == want[r.doc_id]
    told = docs.where("doc_id IS NOT NULL AND length(text) >= 50").selectExpr("doc_id", "xxhash64(text) AS mark", "sha2(text, 256) AS sha", "length(text) AS n")
    copies = suffixes.copied(told)
    assert sorted(r.doc_id for r in copies.collect()) == [7, 9, 14]
    gone = suffixes.passed_over(copies)
    assert len(gone[0]) <= 3 and (most == 2 or gone[0].tolist() == [7, 9, 14])
    sent = [i for b in suffixes.without(told.toArrow().to_batches(), gone) for i in b.column("doc_id").to_pylist()]
    assert sorted(sent) == sorted([2, 5, 5, 7, 8, 13] + [i for i in (7, 9, 14) if i not in gone[0].tolist()])


def test_bitmaps_reach_the_driver_in_parts(spark, docs, monkeypatch):
    """At a small input the bitmap is nearly empty and is sent as such, and rows of it are dealt over partitions."""
    sent = []
    parts = suffixes.in_parts
    for module in (suffixes, jaccard):
        monkeypatch.setattr(module, "in_parts", lambda df: (sent.append(len(r.bits)) or r for r in parts(df)))
    jaccard.join(docs).count()
    suffixes.dedup(docs).count()
    assert len(sent) > 1 and sum(sent) < 1 << 20
    table = spark.range(64).selectExpr("id", "repeat('0', 65536) AS bits").coalesce(1)
    parts = []
    cut = common.cut
    monkeypatch.setattr(common, "cut", lambda df: parts.append(len(glob.glob(cut(df)._path.removeprefix("file://") + "/part-*"))) or cut(df))
    assert sorted(r.id for r in common.in_parts(table)) == list(range(64)) and parts[0] > 16


def test_suffixes_in_order_and_parts_together():
    """Ties of every depth are broken, and small parts of a block share a sort, large ones don't."""
    rng = np.random.default_rng(2)
    sym = np.concatenate([np.tile(rng.integers(1, 257, 90), 4), rng.integers(1, 3, 500), np.full(80, 7)]).astype(np.int64)
    _, key = suffixes.suffix_array(sym)
    own = rng.permutation(len(sym))
    words = lambda i: tuple(key[i + suffixes.PACK * j] for j in range(suffixes.WORDS))
    assert [words(i) for i in suffixes.in_order(own, key)] == sorted(words(i) for i in own)
    sub, size = np.repeat(np.arange(suffixes.SUBS), 3), np.full(3 * suffixes.SUBS, 70)
    assert len(np.unique(suffixes.together(sub, size))) == 1
    assert len(np.unique(suffixes.together(sub, size * 10_000))) == suffixes.SUBS


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for top in (2, 5, 257):
        sym = rng.integers(0, top, 700).astype(np.int32)
        order, key = suffixes.suffix_array(sym)
        cut = [tuple(sym[i : i + 56]) for i in order]
        assert sorted(order.tolist()) == list(range(700)) and all(a <= b or a[: len(b)] == b for a, b in zip(cut, cut[1:], strict=False))
        near = suffixes.common(key, order[:-1], order[1:])
        for n, a, b in zip(near, cut, cut[1:], strict=False):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert n == min(same, 50) or min(len(a), len(b)) < 56


# 5


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 16)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base + rng.normal(scale=0.05, size=base.shape) for _ in range(6)] + [base[:1] + rng.normal(scale=0.02, size=(120, 16)), rng.normal(size=(200, 16)), base, base * 3])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, [None] + [1.0] * 15, 0), (1005, [float("inf")] + [1.0] * 15, 0), (1006, [], 0), (None, x[0].tolist(), 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0)]
    got = vectors.near(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, leaf int")).collect()
    assert len(got) == len(rows) + len(bad)
    by = {r.vec_id: r for r in got}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    found = brute.Sets(range(len(x)))
    for i, j in zip(*np.nonzero(near), strict=True):
        found.tie(int(i), int(j))
    links = sum(by[i].n_links for i in range(len(x)))
    assert 0.99 * (near.sum() - len(x)) <= links <= near.sum() - len(x)
    assert all(by[i].component_id == found.find(i) for i in range(len(x)))
    assert all(by[i].n_links == 0 and by[i].kept for i in range(1001, 1007))
    assert by[1007].n_links == by[1008].n_links == 1 and by[1008].component_id == 1007 and not by[None].kept


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    found = brute.Sets(range(6000))
    for a, b in edges:
        found.tie(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert {r.node: r.component for r in got} == {n: found.find(n) for n in nodes} and len(got) == len(nodes)


# 6


def test_gradient():
    rng = np.random.default_rng(0)
    net = langid.Net.fresh(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, 7)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    x[0, 5:] = langid.PAD

    def loss():
        live = (x != langid.PAD).T
        return -(np.log(net.positions(x)[:, np.arange(5), y]) * live).sum() / live.sum()

    for k, g in net.gradient(x, y).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.p[k][i], 1e-3
        net.p[k][i] = old + e
        up = loss()
        net.p[k][i] = old - e
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / (2 * e) - g[i]) < 1e-4


def test_positions_equal_the_trained_pass():
    """Labelling is the pass that was trained, also where gates saturate, and takes less time than it."""
    rng = np.random.default_rng(1)
    net = langid.Net.fresh(["a", "b", "c", "d"])
    x = rng.integers(0, 257, (2_000, langid.WINDOW)).astype(np.int16)
    net.p["xf"][:9] *= 400

    def slow():
        hidden = np.concatenate([net.pass_one(x, d)[0] for d in "fb"], axis=2)
        logits = hidden @ net.p["o"] + net.p["c"]
        prob = np.exp(logits - logits.max(axis=2, keepdims=True))
        return prob / prob.sum(axis=2, keepdims=True)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert np.abs(net.positions(x) - slow()).max() < 1e-5
    assert min(seconds(lambda: net.positions(x)) for _ in range(5)) < 0.9 * min(seconds(slow) for _ in range(5))


def test_language(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.learn(big)
    got = langid.predict(big, net).join(big.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    odd = langid.predict(docs, net).collect()
    assert len(odd) == docs.count() and {r.lang_pred for r in odd if r.doc_id in (1, 2, 7, 10)} >= {"und"}
    assert all(r.score == 0 for r in odd if r.lang_pred == "und")


# 7


def test_chat(spark):
    tools = {"reply": {"prompt": "string", "turn": "integer"}, "add": {"a": "number", "b": "number?"}}
    ask = json.dumps({"content": "x", "tool_calls": [{"id": "c1", "name": "add", "arguments": {"b": 2.5, "a": 1}}, {"id": "c2", "name": "add", "arguments": {"b": "2", "q": "1"}, "uses": ["c1"]}, {"id": "c3", "name": "none", "arguments": {}}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", ask), (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": "9"})), (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})), (1, None, None, None), (None, 1, "assistant", "yo"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, 0, "tool", "{broken")]
    got = chat.link(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), tools).orderBy("conv_id", "position").collect()
    one = [r for r in got if r.conv_id == 1]
    assert [r.position for r in one] == list(range(1, len(one) + 1))
    order = [(r.kind, r.call_id) for r in one]
    assert order.index(("call", "c1")) < order.index(("result", "c1")) < order.index(("call", "c2")) < order.index(("result", "c2"))
    faults = {r.call_id: r.faults for r in one if r.kind == "call"}
    assert faults == {"t0": [], "c1": [], "c2": ["missing a", "b is no number", "unknown q"], "c3": ["unknown tool none"]}
    assert next(r.json for r in one if r.call_id == "c1" and r.kind == "call") == '{"arguments":{"a":1,"b":2.5},"call_id":"c1","content":"x","kind":"call","name":"add","role":"assistant"}'
    assert [r.linked for r in got if r.conv_id == 2] == [True, True, True] and not got[0].linked
    for r in got:
        assert json.dumps(json.loads(r.json), separators=(",", ":"), ensure_ascii=False) == r.json


def test_chat_circle(spark):
    ask = json.dumps({"content": "x", "tool_calls": [{"id": "a", "name": "n", "arguments": {}, "uses": ["b"]}, {"id": "b", "name": "n", "arguments": {}, "uses": ["a"]}, {"id": "c", "name": "n", "arguments": {}, "uses": ["gone"]}]})
    got = chat.link(chat.events_of(spark.createDataFrame([(1, 1, "assistant", ask)], "conv_id long, turn long, role string, text string")), {"n": {}}).collect()
    assert {r.call_id: r.circular for r in got} == {"a": True, "b": True, "c": False}


def test_chat_whole_table(spark):
    raw = spark.read.parquet(f"{DIR}/conversations.parquet")
    got = queries.op7_linked_chat(spark, DIR).toPandas()
    rows = raw.toPandas()
    assert len(got) == len(rows)
    turns = {(r.conv_id, r.turn): r.role for r in rows.itertuples()}
    for r in got.itertuples():
        other = {"call": turns.get((r.conv_id, r.turn + 1)) == "assistant", "result": turns.get((r.conv_id, r.turn - 1)) == "user"}.get(r.kind, False)
        assert r.linked == other
    assert (got.sort_values(["conv_id", "turn"]).groupby("conv_id").position.apply(list).map(lambda p: p == list(range(1, len(p) + 1)))).all()


# 8


def all_maximal(values):
    """By definition: the best segment, then those on either side of it."""
    best = max(((sum(values[a : b + 1]), -(b - a), a, b) for a in range(len(values)) for b in range(a, len(values))), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return [*all_maximal(values[:a]), (a, b), *[(x + b + 1, y + b + 1) for x, y in all_maximal(values[b + 1 :])]]


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(60):
        v = np.round(rng.normal(-0.2, 1, 25), 3)
        assert [(a, b) for a, b, _ in toxicity.maximal(v)] == all_maximal(v.tolist())


def test_toxicity(spark, docs):
    rng = random.Random(6)
    words = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "or", "ist")]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(60)]
        for k in range(3 if toxic else 0):
            text[10 + 9 * k] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (0, 1)]
    df = table(spark, rows)
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all((got[i].score >= 0.3) == (i % 4 == 0) for i in range(400))
    assert got[0].passages[0].first_word == 10
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score < 0.3 for r in odd)
    assert toxicity.clean(docs, model).count() == docs.count() and toxicity.clean(df, model).count() == 300
    assert df.select(toxicity.held_out("doc_id", 2, 4)).first()[0] == (zlib.crc32(b"0") % 4 == 2)


# 9


@pytest.mark.parametrize("cap", [2, 256])
def test_jaccard(spark, sample, monkeypatch, cap):
    monkeypatch.setattr(jaccard, "CAP", cap)
    rng = random.Random(7)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in sample.limit(60).collect()]
    text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(120)).split()
    for i in range(40):
        changed = list(text)
        for _ in range(i % 5):
            changed[rng.randrange(len(text))] = f"z{rng.randint(0, 9)}"
        rows.append((1000 + i, " ".join(changed), "en", "a"))
    rows += [(2000 + i, t, lang, src) for i, (_, t, lang, src) in enumerate(unique_ids(awkward()))]
    want = brute.jaccard({r[0]: r[1] for r in rows})
    got = jaccard.join(table(spark, [*rows, (None, rows[0][1], None, None)])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
        else:
            assert r.component_id is None


# 10


def test_shards(docs, sample):
    for df in (docs, sample):
        got = shards.interleave(df).toPandas()
        n = len(got)
        assert n == df.count()
        counts = got.groupby("shard").slot.agg(list).reindex(range(24)).map(lambda x: x if isinstance(x, list) else [])
        assert all(sorted(s) == list(range(len(s))) for s in counts) and counts.map(len).max() - counts.map(len).min() <= 1
    by = got.groupby(["source", "shard"]).size().unstack(fill_value=0).reindex(columns=range(24), fill_value=0)
    share = got.groupby("source").size() / 24
    assert (by.sub(share, axis=0).abs() <= 2).all().all()
    first = sample.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("c"), "source").toPandas()
    first["key"] = [hashlib.md5(f"10:{i}:{c}".encode()).hexdigest() for i, c in zip(first.doc_id, first.c, strict=True)]
    first["part"] = (2 * first.groupby("source").key.rank(method="first") - 1) / (2 * first.groupby("source").key.transform("size"))
    order = first.sort_values(["part", "source", "key"]).doc_id.tolist()
    assert got.sort_values(["shard", "slot"]).doc_id.tolist() == order


# pipeline


def test_pipeline(spark, sample):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.learn(sample, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(sample, model).collect()}
    rows = {r.doc_id: r for r in sample.collect() if scores[r.doc_id] < 0.3}
    found = brute.jaccard({i: r.text for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if found[i][1] == i}
    kept = {i: b.decode("utf-8", "ignore") for i, (_, b) in brute.cut_repeats({i: r.text.encode() for i, r in rows.items()}).items()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, kept[i], r.lang, r.source) for i, r in rows.items()], columns=["doc_id", "text", "lang", "source"]))
    ids = con.sql(mixing.oracle(queries.WEIGHTS, (1, 1))).df().doc_id.tolist()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = sorted((i, len(enc.encode_ordinary(kept[i])), hashlib.sha256(kept[i].encode()).hexdigest()) for i in ids)
    got = corpus_pipeline.run(spark, DIR)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_array", "mixing", "byte_bpe"]


def test_stages_delete_their_tables(spark, sample):
    """What is left is what the results read, and links between components."""
    tables = lambda: set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/lf-*"))
    before = tables()
    clean = corpus_pipeline.drop_toxic(spark, sample, DIR)
    assert tables() == before and 0 < clean.count() <= sample.count()
    single = corpus_pipeline.drop_near_duplicates(spark, sample, DIR)
    for path in tables() - before:
        assert set(spark.read.parquet(f"file://{path}").columns) <= {"component", "doc_id", "text_hash", "n", "u", "v"}
    assert 0 < single.count() < sample.count()


def test_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 11)}
