"""Scores of the weighted context trees against the recursion spelt out."""

import math
import random
import zlib
from collections import Counter

import pytest

from locusframe.llm import ctw, queries


def plain(docs, depth, folds=7, fold=2):
    """[(id, n_tokens, n_known, N, base, score)]; docs: (id, text).

    Probabilities come from the weighted probability of all decisions, with and without
    the next one; nothing is shared with the operator but the definition.
    """
    low = lambda t: [w for w in (t or "").encode().translate(ctw.LOWER).replace(b"\x0b", b" ").split() if w]
    stream = lambda t: b"".join(w + b" " for w in low(t)) + b"\n"
    learn = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % folds != fold]
    counts: dict = {}

    def decisions(t):
        s = b"\n" * depth + stream(t)
        for at in range(depth, len(s)):
            node = 1
            for k in range(7, -1, -1):
                bit = s[at] >> k & 1
                yield node, s[at - depth : at], bit
                node = 2 * node + bit

    for t in learn:
        for node, context, bit in decisions(t):
            for d in range(depth + 1):
                counts.setdefault((node, context[depth - d :]), [0, 0])[bit] += 1

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(sum(n) + 1)

    def weighted(node, context, extra=None):
        """Logarithm; ``extra``: one more decision, (context, bit)."""
        n = list(counts.get((node, context), (0, 0)))
        if extra and extra[0].endswith(context):
            n[extra[1]] += 1
        if len(context) == depth:
            return kt(n)
        below = {bytes([x]) + context for x in range(256) if (node, bytes([x]) + context) in counts}
        if extra and extra[0].endswith(context):
            below.add(extra[0][-len(context) - 1 :])
        a, b = kt(n), sum(weighted(node, c, extra if extra and extra[0].endswith(c) else None) for c in below)
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)

    c = Counter(w for t in learn for w in [*low(t), None])
    n, v = sum(c.values()), len(c)
    memo: dict = {}
    out = []
    for i, t in docs:
        total = 0.0
        for node, context, bit in decisions(t):
            if (node, context, bit) not in memo:
                memo[node, context, bit] = weighted(node, b"", (context, bit)) - weighted(node, b"")
            total += memo[node, context, bit]
        tokens = [*low(t), None]
        base = sum(math.log10((c[w] + 1) / ((n + 1) * (v + 1))) for w in tokens)
        out.append((i, len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6), round(total / math.log(10), 6)))
    return out


@pytest.mark.parametrize("depth,block", [(2, 40), (3, 1 << 20)])
def test_scores_equal_the_recursion(spark, depth, block):
    rng = random.Random(depth)
    text = lambda: rng.choice([" ", "\n", "\x0b"]).join(rng.choice(["ab", "Abc", "é", "b", "cab", "\x00", "\x1c"]) for _ in range(rng.randint(1, 9)))
    docs = [(i, text()) for i in range(25)] + [(25, None), (26, ""), (27, " \t "), (2, "ab ab"), (2, "ab ab"), (None, "ab Ab"), (28, "new" * 30), (29, "ab " * 60)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, data string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    rows = ctw.score(frame, depth, block=block).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows), key=key)
    want = sorted(plain(docs, depth), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(a - b) < 2e-6 for g, w in zip(got, want, strict=True) for a, b in zip(g[4:], w[4:], strict=True))
    assert {r.doc_id for r in rows if r.held_out} == {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}


def test_no_texts_and_no_training(spark):
    frame = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    assert ctw.score(frame.limit(0)).count() == 0
    r = ctw.score(frame).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and abs(r.score + 4 * 8 * math.log10(2)) < 1e-9


def test_base_score_of_the_query(spark, tmp_path):
    """The contract's N + 1 * (V + 1) below the line, not (N + 1) * (V + 1)."""
    docs = [(i, t) for i, t in enumerate(["a b A", "b\tc", "", None, "new a", "a \x0b d", "b b b", " e "])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = {i: [*(t or "").lower().replace("\x0b", " ").split(), None] for i, t in docs}
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i in tokens if i not in held for w in tokens[i])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op11_context_trees(spark, str(tmp_path)).collect()}
    assert set(got) == set(tokens) and {i for i in got if got[i].held_out} == held
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws)) < 1e-9


def test_a_block_without_words(spark):
    """Partitions of empty texts alone; their sums of no words are still doubles."""
    frame = spark.createDataFrame([(0, None), (1, ""), (3, " \t")], "doc_id long, text string")
    rows = ctw.score(frame.coalesce(1), additive=True).collect()
    assert sorted((r.doc_id, r.n_tokens, r.train_tokens) for r in rows) == [(i, 1, 3 - sum(zlib.crc32(str(i).encode()) % 7 == 2 for i in (0, 1, 3))) for i in (0, 1, 3)]
