"""What is composed over spans equals the plain loop, at any span."""

import random

import pytest

from locusframe.operators import peaks, spans


def plain_segments(bins, cov, slope, parity):
    out, run, start, top, at, i = [], 0.0, None, -1, None, 0
    while i < len(bins):
        before, run = run, run + (slope[i] or 0)
        if start is None and before <= 0 < run:
            start, top = i, -1
        if start is not None:
            if cov[i] > top:
                top, at = cov[i], i
            if run <= 0 and before > run:
                out.append((bins[start], bins[i], top, bins[at], sum(cov[start : i + 1])))
                run, start = 0.0, None
                i += parity
        i += 1
    return out


def wave(rng, n, kind):
    if kind == "low":
        return [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
    if kind == "high":
        return [50 + rng.randint(0, 9) for _ in range(n)]
    out, c = [], 5
    for _ in range(n):
        c = max(0, c + rng.choice([-3, -1, 0, 1, 3]))
        out.append(c)
    return out


@pytest.mark.parametrize("parity", [False, True])
def test_segments_equal_the_loop(spark, parity):
    rng = random.Random(7)
    rows, want = [], []
    for contig in "abc":
        for sample, kind in (("s", "low"), ("t", "high"), ("u", "walk")):
            cov = wave(rng, rng.choice([1, 2, 60, 97, 150]), kind)
            slope = [None if i in (0, len(cov) - 1) else (cov[i + 1] - cov[i - 1]) / 2 for i in range(len(cov))]
            rows += [(contig, sample, i, c) for i, c in enumerate(cov)]
            want += [(contig, sample, *x) for x in plain_segments(list(range(len(cov))), cov, slope, parity)]
    frame = spark.createDataFrame(rows, "contig string, sample string, bin long, cov long")
    assert len(want) > 12
    for span in (2, 40) if parity else (1, 9, 1 << 16):
        got = peaks.segments(peaks.derivative(frame, span=span), span, parity)
        assert sorted(map(tuple, got.select("contig", "sample", "start", "end", "height", "summit", "area").collect())) == sorted(want), span


def plain_groups(rows, near):
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0], r[3]))
    found: list[list] = []
    for r in rows:
        if found and any(r[3] - m[3] < near for m in found[-1]):
            found[-1].append(r)
        else:
            found.append([r])
    for g in range(len(found) - 1, 0, -1):
        if min(r[1] for r in found[g]) - max(r[2] for r in found[g - 1]) < near:
            found[g - 1] += found.pop(g)
    return [(*r, i) for i, g in enumerate(found) for r in g]


def test_groups_and_merges_equal_the_loop(spark):
    rng = random.Random(2)
    rows = {c: [(rng.choice("xyz"), s := rng.randint(0, 60 * k), s + rng.randint(0, 8), s + rng.randint(0, 8)) for _ in range(40)] for k, c in enumerate("abc", 1)}
    frame = spark.createDataFrame([(c, a, s, e, 1, m, 1) for c, rs in rows.items() for a, s, e, m in rs], peaks.SEGMENTS)
    for span in (3, 1 << 16):
        got = sorted((r.contig, r.sample, r.start, r.end, r.summit, r.group_id) for r in peaks.groups(frame, 3, span).collect())
        assert got == sorted((c, *g) for c, rs in rows.items() for g in plain_groups(rs, 3))
    want = []
    for c, rs in rows.items():
        for a in "xyz":
            own = sorted(r[1:3] for r in rs if r[0] == a)
            out = []
            for s, e in own:
                if out and s - out[-1][1] < 3:
                    out[-1] = (out[-1][0], max(out[-1][1], e))
                else:
                    out.append((s, e))
            want += [(c, a, *x) for x in out]
    for span in (4, 1 << 16):
        assert sorted((r.contig, r.sample, r.start, r.end) for r in peaks.merge_close(frame, 3, span).collect()) == sorted(want)


def test_running_and_halo(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), p, rng.randint(-5, 5)) for p in range(80)]
    frame = spark.createDataFrame(rows, "k string, pos long, v long")
    for span in (1, 7, 1000):
        got = {(r.k, r.pos): (r.s, r.m) for r in spans.running(spans.running(frame, ["k"], ["pos"], "s", spans.F.col("v"), span=spans.span_of("pos", span)), ["k"], ["pos"], "m", spans.F.col("v"), "max", before=True, span=spans.span_of("pos", span)).collect()}
        for k, p, _ in rows:
            upto = [v for c, q, v in rows if c == k and q <= p]
            assert got[k, p] == (sum(upto), max(upto[:-1], default=None))
    numbered = spans.ranked(frame, ["k"], ["pos"], "rank")
    for span in (2, 5, 100):
        dealt = spans.with_halo(numbered, ["k"], "rank", 3, 1, span)
        w = spans.Window.partitionBy("k", "_s").orderBy("rank").rowsBetween(-3, 1)
        got = {(r.k, r.rank): r.n for r in dealt.withColumn("n", spans.F.sum("v").over(w)).where("_own").collect()}
        for k in "ab":
            vs = [v for c, _, v in rows if c == k]
            assert all(got[k, i + 1] == sum(vs[max(0, i - 3) : i + 2]) for i in range(len(vs)))
