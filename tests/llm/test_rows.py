"""Chains of tool calls of any length, and near duplicates decided by row."""

import json
from collections import defaultdict

import corpus_pipeline
from locusframe.llm import chat

DIR = "/root/testdata/sf0.001"


def asked(conv, uses: dict[str, list[str]]) -> list[tuple]:
    """A message a call, the last of ``uses`` in the first turn."""
    text = lambda c, used: json.dumps({"content": "", "tool_calls": [{"id": c, "name": "n", "arguments": {}, "uses": used}]})
    return [(conv, len(uses) - i, "assistant", text(c, used)) for i, (c, used) in enumerate(uses.items())]


def test_chat_chains_of_any_length(spark):
    chain = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(150)}
    braid = {f"c{i}": [f"c{j}" for j in (i - 1, i - 3) if j >= 0] for i in range(9)} | {"d": ["c4"], "e": ["d"], "f": ["e", "c8"]}
    # x and y use each other, z uses them, and w and v don't settle either
    circle = {"v": ["w", "a"], "w": ["z"], "z": ["x"], "x": ["y"], "y": ["x"], "s": ["s"], "a": [], "b": ["a"], "g": ["a", "b"], "h": ["g"]}
    rows = asked(None, chain) + asked(1, chain) + asked(2, braid) + asked(3, circle)
    got = defaultdict(list)
    events = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in sorted(chat.link(events, {"n": {}}).collect(), key=lambda r: r.position):
        got[r.conv_id].append((r.call_id, r.circular))
    assert got[None] == got[1] == [(c, False) for c in chain]
    for conv, uses in ((2, braid), (3, circle)):
        seen: set = set()
        for c, circular in got[conv]:
            assert circular == (conv == 3 and c in "vwzxys")
            assert circular or seen.issuperset(uses[c])
            seen.add(c)
    assert [c for c, circular in got[3] if not circular] == [c for c, _ in got[3]][:4] == ["a", "b", "g", "h"]


def test_near_duplicates_by_row(spark):
    words = lambda start: " ".join(f"word{start}x{i}" for i in range(80))
    a, b, c, d = (words(x) for x in "abcd")
    rows = [
        (1, a, "x"), (1, a, "y"), (1, a, "z"),  # repeated: one stays
        (2, b, "x"), (5, b + " more", "x"), (5, c, "x"),  # 5's other text stays
        (3, d, "x"), (3, d + " more", "x"), (3, a + " more", "x"),  # near copies under one id
        (None, a, "x"), (None, a, "x"), (7, " ", "x"), (7, " ", "x"), (8, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect()]
    assert [r[:2] for r in got].count((1, a)) == 1
    assert sum(r[0] == 3 for r in got) == 1 and {r[1] for r in got if r[0] == 3} <= {d, d + " more"}
    rest = sorted((r for r in got if r[0] not in (1, 3)), key=str)
    assert rest == sorted([(2, b, "x"), (5, c, "x"), *rows[9:]], key=str)


def test_chat_types_and_nesting(spark):
    """Arguments keep their types, are checked by them, and are canonical at any depth."""
    tools = {"s": {"query": "string", "limit": "integer", "opts": "object?", "tags": "array?", "on": "boolean?", "x": "number?"}}
    calls = [
        {"id": "a", "name": "s", "arguments": {"query": "q", "limit": 3, "opts": {"z": [1, {"b": 2, "a": 1}], "k": None}, "tags": [1, "x"], "on": True, "x": 1.5}},
        {"id": "b", "name": "s", "arguments": {"query": 5, "limit": "3", "opts": [], "tags": {}, "on": "true", "x": "1"}},
        {"id": "c", "name": "s", "arguments": {"limit": 2.5, "query": None}},
    ]
    rows = [(1, 0, "assistant", json.dumps({"content": "", "tool_calls": calls}))]
    got = {r.call_id: r for r in chat.link(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), tools).collect()}
    assert got["a"].faults == [] and got["b"].faults == [f"{p} is no {t.rstrip('?')}" for p, t in tools["s"].items()]
    assert got["c"].faults == ["missing query", "limit is no integer"]
    for c in calls[:2]:
        assert json.dumps(c["arguments"], sort_keys=True, separators=(",", ":")) in got[c["id"]].json


def test_chat_keeps_turns(spark):
    """Turns stay in order unless a use demands otherwise, and the last answer is linked to the user's question."""
    call = lambda turn, i, uses=(): (7, turn, "assistant", json.dumps({"content": "", "tool_calls": [{"id": i, "name": "n", "arguments": {}, "uses": list(uses)}]}))
    back = lambda turn, i: (7, turn, "tool", json.dumps({"tool_call_id": i, "content": "r"}))
    rows = [(7, 0, "user", "ask"), call(1, "a"), back(2, "a"), call(3, "b", ["a"]), back(4, "b"), (7, 5, "assistant", "answer"), (7, 6, "user", "more"), (7, 7, "assistant", "done"), call(8, "c", ["d"]), (7, 9, "system", "x"), call(10, "d"), back(11, "d"), (7, None, "system", "first")]
    got = sorted(chat.link(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), {"n": {}}).collect(), key=lambda r: r.position)
    assert [(r.turn, r.call_id) for r in got] == [(None, None), (0, "t0"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "t0"), (6, "t6"), (7, "t6"), (9, None), (10, "d"), (11, "d"), (8, "c")]
    assert all(r.linked for r in got if r.call_id in ("a", "b", "t0", "t6", "d")) and not next(r for r in got if r.call_id == "c").linked
