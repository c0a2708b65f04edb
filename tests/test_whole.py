"""Queries over whole tables, against literal counts of all rows."""

import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from locusframe.operators import coverage, pairs, peaks
from locusframe.plans import catalog, views
from tests.test_spans import plain_segments

DIR = "/root/testdata/sf0.001"


def table(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{DIR}/{name}.parquet")


def found(spark, name: str, *cols: str) -> list[tuple]:
    return sorted(tuple(r[c] for c in cols) for r in catalog.QUERIES[name](spark, DIR).collect())


def test_pileup_of_all_documents(spark):
    flip = str.maketrans("ACGT", "TGCA")
    ref, piled = defaultdict(str), defaultdict(list)
    for i, text in table("documents").sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
        seq, at = re.sub("[^ACGT]", "", text.upper()), len(ref[i % 3]) + 1
        ref[i % 3] += seq
        for j, base in enumerate(seq[7:]):
            piled[i % 3, at + j].append((base, (i % 2 == 1) != (i % 5 == 0)))
    want = []
    for (c, pos), reads in piled.items():
        three = ref[c][pos - 2 : pos + 1] if pos > 1 else ""
        here, neg = ref[c][pos - 1], ref[c][pos - 1] == "G"
        if here not in "CG":
            continue
        n = Counter()
        for base, bis in reads:
            b = base.translate(flip) if neg else base
            n[("c" if b == "C" else "t" if b == "T" else "ag") if neg == bis else "opp"] += 1
            n["opp_a"] += neg != bis and b == "T"
        if n["c"] + n["t"] and n["opp_a"] / max(1, n["opp_a"] + n["opp"]) <= 0.101:
            ctx = (three.translate(flip)[::-1] if neg else three) if len(three) == 3 else None
            want.append((f"chr{c}", pos, neg, ctx, n["c"], n["t"], n["ag"], n["opp"], n["opp_a"]))
    got = catalog.QUERIES["cytosine_pileup_calls"](spark, DIR).collect()
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_placed_over_stretches(spark):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(views.placed(spark, DIR, 7)) == key(views.placed(spark, DIR))


SIX = ("n_m", "n_u", "n_mm", "n_mu", "n_um", "n_uu")


@pytest.mark.parametrize("only_different", [False, True])
def test_any_read_equals_chosen(spark, only_different):
    cr = views.cytosine_reads(spark, DIR)
    want = pairs.histogram(pairs.chosen(pairs.near_pairs(cr, cr, 30, ["contig"]), only_different))
    got = pairs.any_read(cr, 30, only_different)
    assert sorted(map(tuple, got.select("dist", *SIX).collect())) == sorted(map(tuple, want.select("dist", *SIX).collect()))


@pytest.mark.parametrize("name", ["pairs_autocorr", "pairs_autocorr_different_read"])
def test_pairs_of_all_first_reads(spark, name):
    t = table("lineitem")
    at = defaultdict(dict)
    low = t.groupby(["l_returnflag", "l_partkey", "l_orderkey"])["l_linenumber"].min()
    for (contig, pos, rd), line in low.items():
        at[contig, pos][rd] = line % 2 == 1
    n = Counter()
    for (contig, pos), a in at.items():
        for dist in range(199):
            b = at.get((contig, pos + dist + 1), {})
            first = sorted(b)[:2]
            for rd, meth in a.items():
                if name == "pairs_autocorr":
                    met = first[: 2 if first[:1] == [rd] else 1]
                else:
                    met = [x for x in first if x != rd][:1]
                for x in met:
                    n[dist, meth, b[x]] += 1
    count = lambda d, a, b: sum(n[d, x, y] for x in a for y in b)
    t, f, both = (True,), (False,), (True, False)
    want = [(d, count(d, t, both), count(d, f, both), count(d, t, t), count(d, t, f), count(d, f, t), count(d, f, f)) for d in sorted({k[0] for k in n})]
    assert found(spark, name, "dist", *SIX) == want


def depths() -> tuple[dict, dict]:
    """Depth by (contig, position), and by (contig, position) the depth of each read group, of all reads."""
    each: dict = defaultdict(Counter)
    for contig, rg, part, quantity in table("lineitem")[["l_returnflag", "l_linestatus", "l_partkey", "l_quantity"]].itertuples(index=False):
        for pos in range(part + 1, part + int(quantity) + 1):
            each[contig, pos][rg] += 1
    return {k: sum(v.values()) for k, v in each.items()}, each


def test_exclusive_over_all_reads(spark):
    depth, each = depths()
    groups = sorted({g for v in each.values() for g in v})
    alone = {k: next(iter(v)) for k, v in each.items() if len(v) == 1}
    sign = {g: -1 if i % 2 else 1 for i, g in enumerate(sorted(set(alone.values())))}
    assert found(spark, "exclusive_read_group", "contig", "pos", "signed_depth") == sorted((*k, sign[g] * depth[k]) for k, g in alone.items())
    n = Counter(alone.values())
    assert found(spark, "exclusive_read_group_summary", "rg", "n_loci") == [(g, n[g]) for g in groups if n[g]]


def test_merge_intervals_of_all_reads(spark):
    depth, _ = depths()
    assert sum(en - st + 1 for st, en in found(spark, "merge_intervals", "st", "en")) == len(depth)


def test_peaks_of_all_reads(spark):
    _, each = depths()
    length, samples = max(p for _, p in each), sorted({g for v in each.values() for g in v})
    cov = {}
    for contig in sorted({c for c, _ in each}):
        for rg in samples:
            for b in range(length // 10 + 1):
                cov[contig, rg, b] = max(each[contig, p][rg] if (contig, p) in each else 0 for p in range(10 * b, 10 * b + 10))
    assert found(spark, "peak_bins", "contig", "sample", "bin", "cov") == sorted((*k, v) for k, v in cov.items())
    slopes = [(c, s, b, round((cov[c, s, b + 1] - cov[c, s, b - 1]) / 2, 6) if 0 < b < length // 10 else None) for c, s, b in sorted(cov)]
    assert found(spark, "peak_derivative", "contig", "sample", "bin", "slope") == slopes
    want = []
    for contig, rg in sorted({k[:2] for k in cov}):
        rows = [(b, cov[contig, rg, b], slope or 0.0) for c, s, b, slope in slopes if (c, s) == (contig, rg)]
        want += [(contig, rg, *x) for x in plain_segments(*[list(x) for x in zip(*rows, strict=True)], parity=False)]
    assert found(spark, "peak_segments", "contig", "sample", "start", "end", "height", "summit", "area") == sorted(want)
    simple = Counter()
    for (c, s, b), v in cov.items():
        simple[c, b // 20] += v * (-1 if samples.index(s) % 2 else 1)
    assert found(spark, "peak_diff_simple", "contig", "region", "score") == sorted((*k, v) for k, v in simple.items())
    n = table("lineitem").groupby("l_linestatus").size()
    rpkm = defaultdict(Counter)
    for (c, s, b), v in cov.items():
        rpkm[c, b // 20][s] += 1e9 * v / 19 / int(n[s])
    for c, region, score in found(spark, "peak_diff_rpkm", "contig", "region", "score"):
        x = rpkm[c, region].values()
        assert score == pytest.approx(max(x) / min(x) - 1 if min(x) else -max(x), abs=1e-5)


def test_matrix_inverted_beyond_500_rows(spark, tmp_path):
    vectors = [[float((7 * i + j) % 11) for j in range(64)] for i in range(503)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.row, r.col): r.v for r in catalog.QUERIES["matrix_sum_inverted"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): vectors[i][j] + vectors[502 - i][63 - j] for i in range(503) for j in range(64)}


def test_downsampling_ends_unthinned(spark):
    runs = [(1, 40, 3), (41, 60, 0), (61, 100, 7)]
    df = spark.createDataFrame([("c", *r) for r in runs], "contig string, st long, en long, depth long")
    depth = {p: d for st, en, d in runs for p in range(st, en + 1)}
    for targets, want in ((3, 4), (20, 4), (1, 2)):  # 400 bases; 100 a target
        got = {r.step: r for r in coverage.downsampled(coverage.thinned(df, 100, targets)).collect()}
        assert sorted(got) == list(range(1, want + 1))
        assert (got[want].n, got[want].sum_depth, got[want].max_depth) == (100, 400, 7)
    ladders = defaultdict(dict)
    for r in coverage.ladder(coverage.thinned(df, 100, 2), 2, by=["step"]).collect():
        ladders[r.step][r.pct] = r.depth
    assert sorted(ladders) == [1, 2, 3]
    full = sorted(depth.values())
    assert ladders[3] == {pct: full[pct] for pct in range(2, 100, 2)}
    assert all(ladders[1][pct] <= 7 for pct in range(2, 100, 2))


def test_downsampling_percentiles_registered(spark):
    assert {r.step for r in catalog.QUERIES["downsample_coverage_percentiles"](spark, DIR).collect()} == {1}


def test_clusters_of_each_contig_and_sample(spark):
    """A shallow sample keeps its peaks, a deep one loses its own noise."""
    rows = []
    for contig, sample, scale in (("a", "s", 1), ("a", "t", 1000), ("b", "s", 30)):
        for level in range(1, 6):
            for i in range(4):
                n = len(rows) * 10
                rows.append((contig, sample, n, n + 5, level * 100 * scale + i, n + 2, level * 400 * scale + i))
    rows += [("c", "s", 0, 5, 7, 2, 20), ("c", "s", 9, 12, 3, 10, 5)]
    got = peaks.clusters(spark.createDataFrame(rows, peaks.SEGMENTS)).collect()
    want = [(*r, min(4, r[4] // (100 * {"s": 1, "t": 1000}[r[1]] if r[0] == "a" else 3000) - 1)) for r in rows if r[0] != "c"]
    want = [r for r in want if r[-1] > 0] + [(*rows[-2], 1), (*rows[-1], 0)]
    assert sorted(map(tuple, got)) == sorted(want)
