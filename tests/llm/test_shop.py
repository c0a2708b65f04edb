"""Funnels and the conversation trie against plain loops, and both against their SQL."""

import glob
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest

from locusframe.llm import funnels, queries, trie
from tests.test_catalog import rows

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_ordered_funnels", "op13_conversation_trie"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def plain_funnels(events, within=300):
    """{(funnel, client): [n1..n4, deepest, t2..t4]}; events: (client, kind, second)."""
    by = defaultdict(list)
    for c, k, t in set(events):
        if None not in (c, k, t):
            by[c].append((t, k))
    out = {}
    for name, (steps, bad) in funnels.FUNNELS.items():
        for c, own in by.items():
            n, waits = Counter(), defaultdict(list)
            for first in [t for t, k in own if k == steps[0]]:
                now, reached = first, 1
                for kind in steps[1:]:
                    later = [t for t, k in own if k == kind and t > now]
                    if not later or min(later) - first > within or any(now < t <= min(later) for t, k in own if k == bad):
                        break
                    reached += 1
                    waits[reached].append((min(later) - now) * 10**6)
                    now = min(later)
                for s in range(1, reached + 1):
                    n[s] += 1
            if n:
                out[name, c] = [*(n[s] for s in (1, 2, 3, 4)), max(n), *(sorted(waits[s])[-(-25 * len(waits[s]) // 100) - 1] if waits[s] else None for s in (2, 3, 4))]
    return out


def test_funnels_equal_loops(spark):
    rng = random.Random(5)
    kinds = ["view", "click", "purchase", "signup", "error", "other", None]
    # one busy client over two days, ties, repeats, nulls, and steps of just five minutes
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choices(kinds, [6, 6, 3, 2, 1, 1, 1])[0], rng.randint(0, 4000) + 86_400 * (rng.random() < 0.3)) for _ in range(900)]
    events += [(9, "view", 0), (9, "click", 299), (9, "view", 300), (9, "purchase", 301), (8, "view", 0), (8, "click", 300), (7, "view", 5), (7, "click", 5), (6, "view", 1), (6, "error", 2), (6, "click", 2), (5, "view", None), (4, "error", 3)]
    start = datetime(2024, 1, 31, 23, 50)
    data = [(c, k, None if t is None else start + timedelta(seconds=t), "x") for c, k, t in events + events[:50]]
    frame = spark.createDataFrame(data, "client_id long, kind string, arrived_at timestamp_ntz, client string")
    got = {(r.funnel, r.client_id): r for r in funnels.count(frame).collect()}
    want = plain_funnels(events)
    assert {k: [*r[2:10]] for k, r in got.items()} == want
    depth = Counter((k[0], v[4]) for k, v in want.items())
    assert all(r.same_depth == depth[k[0], r.deepest] for k, r in got.items())
    assert funnels.count(frame.limit(0)).count() == 0


def test_steps_join_what_they_ask_for(spark, monkeypatch):
    """Each step's table holds the counts that later steps read."""
    made = []
    cut = funnels.cut
    monkeypatch.setattr(funnels, "cut", lambda df, *a: made.append(df) or cut(df, *a))
    rows_ = [(1, kind, 10 * i) for i, kind in enumerate(["view", "click", "view", "purchase", "error", "signup", "view"])]
    events = spark.createDataFrame(rows_, "client long, kind string, at long")
    funnels.attempts(events, funnels.FUNNELS, 300).collect()
    _, *steps = made  # kinds in order: click, error, purchase, signup, view
    assert [sorted(c for c in df.columns if c[:2] == "n_") for df in steps] == [["n_0", "n_1", "n_2", "n_3", "n_4"], ["n_1", "n_2", "n_3", "n_4"], []]


def plain_trie(table):
    """{(owner, depth): row}; table: (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    say = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    new = {}
    for c in say:
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = say.get(c - c % 20, [])[:h] + say[c][h:]
    members = defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
    words = lambda t: len([w for w in t.encode().split() if w])
    out = {}
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = [c for c in convs if len(new[c]) == len(path)]
        saved = sum((len(members[p]) - 1) * words(p[-1][1]) for p in below if p)
        out[convs[0], len(path)] = (
            members[path[:-1]][0] if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below), sum(leaf(p) for p in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def test_trie_equals_loops(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 3)
    monkeypatch.setattr(trie, "PIECE", 16)
    rng = random.Random(3)
    table = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "a\tb  d"])) for c in range(0, 70) for t in range(rng.randint(1, 4))]
    table += [(c, t, "user", f"same {t}") for c in [*range(100, 160), 3001] for t in range(9)]  # copies, in several pieces
    table += [(c, t, "user", f"same {t}" if t < 20 - c % 7 else f"{c}") for c in range(200, 209) for t in range(24)]  # long, apart late
    table += [(300, None, None, None), (300, 2, None, ""), (301, 5, "user", None), (None, 1, "user", "lost"), (319, 1, "user", "x"), (400, 1, "user", "y z"), (400, 1, "user", "y z")]
    frame = spark.createDataFrame([(*r, 1, "u") for r in table], "conv_id long, turn long, role string, text string, place int, conv string")
    got = {(r.conv_id, r.depth): tuple(r[2:]) for r in trie.nodes(frame).collect()}
    assert got == plain_trie(table)
    assert trie.nodes(frame.limit(0)).count() == 0
