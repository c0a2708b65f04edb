"""Peak calling on binned coverage.

A contig is dealt over spans of bins throughout.  Derivatives see the neighbouring bins
of a halo.  The state machine of the segmentation is composed over spans: a span's effect
is a step function of the running sum with which it is entered, so a scan over these
functions, a few numbers a span, tells with which state each span begins, and all spans
then find their peaks at once.  Grouping of summits depends on the group so far only
between gaps, and the stretches between gaps are apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.spans import SPAN, running, span_of, with_halo
from locusframe.sources.shared import cut


def dense_bins(runs: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """``contig, sample, bin, cov`` with the largest depth of each bin; ``runs`` has a sample."""
    parts = runs.select("contig", "sample", "depth", F.explode(F.sequence(F.expr(f"st div {width}"), F.expr(f"en div {width}"))).alias("bin"))
    return parts.groupBy("contig", "sample", "bin").agg(F.max("depth").cast("long").alias("cov"))


def derivative(bins: DataFrame, window: int = 3, span: int = SPAN) -> DataFrame:
    """Slope of the least-squares parabola over ``window`` dense bins at its middle; null at the ends."""
    half = window // 2
    norm = float(sum(j * j for j in range(-half, half + 1)))
    dealt = with_halo(bins.withColumn("_rank", F.col("bin") + 1), ["contig", "sample"], "_rank", half, half, span)
    w = Window.partitionBy("contig", "sample", "_s").orderBy("bin")
    slope = sum((F.lead("cov", j).over(w) if j > 0 else F.lag("cov", -j).over(w)) * j for j in range(-half, half + 1) if j) / norm
    return dealt.withColumn("slope", F.round(slope, 6)).where("_own").drop("_rank", "_s", "_own")


# ---- segmentation -----------------------------------------------------------------------


def first(levels: np.ndarray, start: np.ndarray, than: np.ndarray, above: bool) -> np.ndarray:
    """For each start, the first place from it on whose level is above ``than`` (or, without
    ``above``, not above it); the number of levels if there is none."""
    n, pick = len(levels), np.maximum if above else np.minimum
    tables = [levels]
    while 2 << (len(tables) - 1) <= n:
        half = 1 << (len(tables) - 1)
        tables.append(pick(tables[-1][:-half], tables[-1][half:]))
    at = np.minimum(start, n).astype(np.int64)
    for j in range(len(tables) - 1, -1, -1):
        fits = at + (1 << j) <= n
        most = tables[j][np.where(fits, at, 0)]
        at += np.where(fits & (most <= than if above else most > than), 1 << j, 0)
    return at


def effect(x: np.ndarray, bins: np.ndarray, parity: bool) -> dict:
    """What a span does to the running sum with which it is entered.

    The sum is compared with 0, so entering with r means comparing the span's own sums with
    -r: between two of their values nothing changes.  ``level`` are these values; by them,
    ``shut_*`` hold for an entry between peaks and ``open_*`` for one within a peak: the bin
    at which a peak opens (-1: none) that stays open or closes, and the state at the
    span's end, if the sum starts anew in between (``sum``; else it just goes on).
    """
    n, p = len(x), np.cumsum(x)
    # after a peak that closes at k: the level of the new sum and where it goes on
    k = np.arange(-1, n)
    past = np.minimum(k + 1, n - 1) if parity else k
    level, on = np.where(past >= 0, p[past], 0), np.minimum(k + (2 if parity else 1), n)
    opens = first(p, on, level, True)
    closes = first(p, opens + 1, level, False)
    ends = np.where(closes < n, closes + 1, np.arange(n + 1))  # places in k
    while (ends[ends] != ends).any():
        ends = ends[ends]
    left = p[-1] - level
    start = np.where(opens < n, bins[np.minimum(opens, n - 1)], -1)
    skip = (k == n - 1) & parity
    left = np.where(skip, 0, left)[ends]
    start, skip = np.where(skip, -1, start)[ends], skip[ends]
    values = np.unique(p)
    i = first(p, np.zeros(len(values)), values, True)
    j = first(p, i + 1, values, False)
    o = first(p, np.zeros(len(values)), values, False)
    done = lambda at, what: np.where(at < n, what[np.minimum(at + 1, n)], -1)
    return {
        "level": values, "total": int(p[-1]), "first_bin": int(bins[0]), "shut_bin": np.where(i < n, bins[np.minimum(i, n - 1)], -1), "shut_anew": j < n, "shut_sum": done(j, left), "shut_start": done(j, start),
        "shut_skip": done(j, skip) == 1, "open_anew": o < n, "open_sum": done(o, left), "open_start": done(o, start), "open_skip": done(o, skip) == 1, "skip_sum": int(left[0]), "skip_start": int(start[0]), "skip_skip": bool(skip[0]),
    }


EFFECT = (
    "contig string, sample string, span long, level array<long>, total long, first_bin long, shut_bin array<long>, shut_anew array<boolean>, shut_sum array<long>, shut_start array<long>, shut_skip array<boolean>, "
    "open_anew array<boolean>, open_sum array<long>, open_start array<long>, open_skip array<boolean>, skip_sum long, skip_start long, skip_skip boolean"
)
STATE = "contig string, sample string, span long, run long, began long, skip boolean"


def composed(key, spans: pd.DataFrame) -> pd.DataFrame:
    """The state with which each span of one contig and sample is entered: the running sum,
    the bin at which the open peak began (-1: none), whether the first bin is passed over."""
    out, run, began, skip = [], 0, -1, False
    for s in spans.sort_values("span").itertuples():
        out.append((*key, s.span, run, began, skip))
        if skip:
            run, began, skip = s.skip_sum, s.skip_start, s.skip_skip
            continue
        at = int(np.searchsorted(s.level, -run, side="right")) - 1
        if began >= 0:
            anew, sum_, start, skips = (s.open_anew, s.open_sum, s.open_start, s.open_skip) if at >= 0 else ([], [], [], [])
            opened = began
        else:
            anew, sum_, start, skips = (s.shut_anew, s.shut_sum, s.shut_start, s.shut_skip) if at >= 0 else ([], [], [], [])
            opened = s.shut_bin[at] if at >= 0 else s.first_bin
        if at >= 0 and anew[at]:
            run, began, skip = int(sum_[at]), int(start[at]), bool(skips[at])
        else:
            run, began = run + s.total, int(opened)
    return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])


def pieces(bins: list, cov: list, x: list, run: int, began: int, skip: bool, parity: bool) -> list[tuple]:
    """Peaks, and parts of them, in a span: (start, end or None, height, summit, area)."""
    out, top, summit, area = [], -1, -1, 0
    for b, c, d in zip(bins, cov, x, strict=True):
        if skip:
            skip = False
            continue
        before, run = run, run + d
        if began < 0 and before <= 0 < run:
            began = b
        if began >= 0:
            area += c
            if c > top:
                top, summit = c, b
            if run <= 0 and before > run:
                out.append((began, b, top, summit, area))
                run, began, top, summit, area, skip = 0, -1, -1, -1, 0, parity
    if began >= 0 and top >= 0:
        out.append((began, None, top, summit, area))
    return out


SEGMENTS = "contig string, sample string, start long, end long, height long, summit long, area long"


def segments(slopes: DataFrame, span: int = SPAN, parity: bool = False) -> DataFrame:
    """Peaks of each contig and sample from ``contig, sample, bin, cov, slope``.

    A peak opens where the running sum of slopes rises above 0 and closes where it falls
    back to 0 or below; then the sum starts anew at the next bin, with ``parity`` one bin
    later.  The summit is the first of the highest bins.  Peaks that don't close are left out.
    """
    rows = slopes.select("contig", "sample", "bin", "cov", F.coalesce(F.round(F.col("slope") * 1_000_000), F.lit(0)).cast("long").alias("x"), span_of("bin", span).alias("span"))
    rows = cut(rows)
    keys = ["contig", "sample", "span"]

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        found = effect(pdf.x.to_numpy(np.int64), pdf.bin.to_numpy(np.int64), parity)
        return pd.DataFrame([{"contig": key[0], "sample": key[1], "span": key[2], **found}])

    def peaks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        s = pdf.iloc[0]
        found = pieces(pdf.bin.tolist(), pdf["cov"].tolist(), pdf.x.tolist(), int(s.run), int(s.began), bool(s.skip), parity)
        return pd.DataFrame([(*key[:2], *f) for f in found], columns=[c.split()[0] for c in SEGMENTS.split(", ")]).astype({"end": "Int64"})

    states = rows.groupBy(*keys).applyInPandas(summary, EFFECT).groupBy("contig", "sample").applyInPandas(composed, STATE)
    parts = rows.join(states, keys).groupBy(*keys).applyInPandas(peaks, SEGMENTS)
    high = F.max(F.struct("height", (-F.col("summit")).alias("back"))).alias("high")
    whole = parts.groupBy("contig", "sample", "start").agg(F.max("end").alias("end"), high, F.sum("area").alias("area")).where("end IS NOT NULL")
    return whole.select("contig", "sample", "start", "end", F.col("high.height").alias("height"), (-F.col("high.back")).alias("summit"), "area")


def merge_close(peaks: DataFrame, gap: int = 3, span: int = SPAN) -> DataFrame:
    """Peaks of a sample less than ``gap`` bins apart become one; it is as high as the highest."""
    p = cut(peaks.select("contig", "sample", "start", "end", "height", "area"))
    p = running(p, ["contig", "sample"], ["start", "end"], "reach", F.col("end"), "max", before=True, span=span_of("start", span))
    p = cut(p.withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") - F.col("reach") >= gap), 1).otherwise(0).cast("long")))
    p = running(p, ["contig", "sample"], ["start", "end"], "g", F.col("new"), span=span_of("start", span))
    return p.groupBy("contig", "sample", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("height").alias("height"), F.sum("area").alias("area")).drop("g")


#: Bins in which peaks and bins of coverage meet.
MEET = 1 << 10


def recentre(peaks: DataFrame, bins: DataFrame, share: float = 0.2) -> DataFrame:
    """Summit: among bins above ``share`` of the height, the first with half their coverage behind it.

    Peaks meet their bins in an equi-join on stretches of bins; the stretches' totals are
    carried along, so a peak of any width is dealt over tasks.
    """
    keys = ["contig", "sample", "start", "end", "height"]
    p = peaks.select(*keys, F.explode(F.sequence(F.expr(f"start div {MEET}"), F.expr(f"end div {MEET}"))).alias("_m"))
    j = p.join(bins.select("contig", "sample", "bin", "cov", F.expr(f"bin div {MEET}").alias("_m")), ["contig", "sample", "_m"])
    j = cut(j.where(F.col("bin").between(F.col("start"), F.col("end")) & (F.col("cov") > share * F.col("height"))))
    total = j.groupBy(*keys).agg(F.sum("cov").alias("all"))
    behind = running(j, keys, ["bin"], "cum", F.col("cov"), span=F.col("_m")).join(total, keys).where("cum * 2 >= all")
    return behind.groupBy(*keys).agg(F.min("bin").alias("summit"))


GROUPED = "contig string, sample string, start long, end long, height long, summit long, group_id long"


def groups(peaks: DataFrame, near: int = 3, span: int = SPAN) -> DataFrame:
    """Peaks of all samples with the number of their group in the contig, from 0.

    In order of start a peak joins the last group if any of its summits lies less than
    ``near`` bins before, which is so if the smallest does.  A summit ``near`` or more behind
    every earlier one begins a group whatever came before: only between such gaps the
    group so far counts, so these stretches are folded apart.  Then groups whose gap is
    under ``near`` become one.
    """
    cols = ["start", "end", "sample", "summit", "height"]
    order = ["start", "end", "sample", "summit"]
    by = span_of("start", span)
    p = cut(peaks.select("contig", *cols))
    p = running(p, ["contig"], order, "highest", F.col("summit"), "max", before=True, span=by)
    p = cut(p.withColumn("gap", F.when(F.col("highest").isNull() | (F.col("summit") - F.col("highest") >= near), 1).otherwise(0).cast("long")))
    p = running(p, ["contig"], order, "island", F.col("gap"), span=by)
    row = F.struct(*[F.col(c) for c in order], "height")
    islands = p.groupBy("contig", "island").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    least = F.lit(None).cast("long")
    zero = F.struct(F.lit(-1).cast("long").alias("n"), least.alias("low"), F.array().cast("array<bigint>").alias("out"))

    def join(s, x):
        joins = s["low"].isNotNull() & (x["summit"] - s["low"] < near)
        n = F.when(joins, s["n"]).otherwise(s["n"] + 1)
        return F.struct(n.alias("n"), F.when(joins, F.least(s["low"], x["summit"])).otherwise(x["summit"]).alias("low"), F.concat(s["out"], F.array(n)).alias("out"))

    numbered = islands.select("contig", "island", F.explode(F.arrays_zip("rows", F.aggregate("rows", zero, join, lambda s: s["out"]).alias("part"))).alias("z")).select("contig", "island", "z.part", "z.rows.*")
    numbered = cut(numbered)
    g = cut(numbered.groupBy("contig", "island", "part").agg(F.min("start").alias("from"), F.max("end").alias("to"), F.min(F.struct(*order)).alias("first")))
    # a group's gap to the one before it, over the borders of spans too
    line = ["from", "island", "part"]
    g = running(g, ["contig"], line, "number", F.lit(1).cast("long"), span=span_of("from", span))
    g = cut(g)
    before = g.select("contig", (F.col("number") + 1).alias("number"), F.col("to").alias("before"))
    g = g.join(before, ["contig", "number"], "left").withColumn("new", F.when(F.col("before").isNull() | (F.col("from") - F.col("before") >= near), 1).otherwise(0).cast("long"))
    g = running(cut(g), ["contig"], ["number"], "group_id", F.col("new"), span=span_of("number", span)).select("contig", "island", "part", (F.col("group_id") - 1).alias("group_id"))
    return numbered.join(g, ["contig", "island", "part"]).select("contig", "sample", "start", "end", "height", "summit", "group_id")


def group_summary(grouped: DataFrame) -> DataFrame:
    out = grouped.groupBy("contig", "group_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("height").alias("height"), F.max_by("summit", F.struct("height", -F.col("summit"))).alias("summit"), F.count("*").alias("n_peaks"), F.count_distinct("sample").alias("n_samples")
    )
    return out.withColumn("width", F.col("end") - F.col("start"))


def rpkm_diff(regions: DataFrame, bins: DataFrame, totals: DataFrame) -> DataFrame:
    """Score of each region from its samples' RPKM: one sample, its own; any at zero, minus the
    largest; else largest over smallest, less one."""
    r = regions.select("contig", "region", "start", "end", F.explode(F.sequence(F.expr(f"start div {MEET}"), F.expr(f"end div {MEET}"))).alias("_m"))
    j = r.join(bins.select("contig", "sample", "bin", "cov", F.expr(f"bin div {MEET}").alias("_m")), ["contig", "_m"]).where(F.col("bin").between(F.col("start"), F.col("end")))
    per = j.groupBy("contig", "region", "start", "end", "sample").agg(F.sum("cov").alias("cov")).join(totals, "sample")
    per = per.withColumn("rpkm", F.try_divide(F.lit(1e9) * F.col("cov"), ((F.col("end") - F.col("start")) * F.col("n_reads")).cast("double")))
    out = per.groupBy("contig", "region").agg(F.count("*").alias("n"), F.min("rpkm").alias("lo"), F.max("rpkm").alias("hi"))
    score = F.when(F.col("n") == 1, F.col("hi")).when(F.col("lo") == 0, -F.col("hi")).otherwise(F.try_divide("hi", "lo") - 1)
    return out.select("contig", "region", F.col("n").alias("n_samples"), F.round(score, 6).alias("score"))


def scored(bins: DataFrame, region: Column, value: Column, score: Column) -> DataFrame:
    """A score strategy of one's own: ``value``, an aggregate of a region's bins in each
    sample, and ``score``, an aggregate of these over the samples."""
    per = bins.groupBy("contig", region.alias("region"), "sample").agg(value.alias("value"))
    return per.groupBy("contig", "region").agg(F.count("*").alias("n_samples"), score.alias("score"))


def simple_diff(peaks: DataFrame, region) -> DataFrame:
    """Heights of even samples minus those of odd ones, samples in order of name."""
    order = peaks.select("sample").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("sample")) - 1)
    sign = F.when(F.col("i") % 2 == 0, 1).otherwise(-1)
    return peaks.join(F.broadcast(order), "sample").groupBy("contig", region.alias("region")).agg(F.sum(F.col("height") * sign).cast("long").alias("score"))


def fit(points: np.ndarray, weight: np.ndarray, k: int, restarts: int, seed: int) -> np.ndarray:
    """k-means++ over distinct points: the number of each one's cluster in the best of the
    seeded restarts, by the sum of squared distances; clusters are numbered by the first
    coordinate of their centres, from the lowest."""
    rng, best, least = np.random.default_rng(seed), np.zeros(len(points), np.int64), np.inf
    away = lambda at: ((points - at) ** 2).sum(1)
    for _ in range(restarts):
        centres = points[rng.choice(len(points), 1, p=weight / weight.sum())]
        while len(centres) < min(k, len(points)):
            far = weight * np.min([away(c) for c in centres], 0)
            centres = np.vstack([centres, points[rng.choice(len(points), p=far / far.sum())]])
        label = None
        while True:
            dist = np.stack([away(c) for c in centres], 1)
            new = dist.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            for c in range(len(centres)):
                if (label == c).any():
                    centres[c] = np.average(points[label == c], 0, weight[label == c])
        cost = (dist.min(1) * weight).sum()
        if cost < least:
            least, best = cost, np.argsort(np.lexsort((centres[:, 1], centres[:, 0])))[label]
    return best


def clusters(peaks: DataFrame, k: int = 5, keep: int = 4, seed: int = 1, restarts: int = 100) -> DataFrame:
    """k-means over (height, area) in each contig and sample; the peaks of its ``keep`` clusters
    with the highest centres.

    ``cluster`` counts from the lowest centre; with fewer than ``k`` distinct peaks each
    distinct one is a cluster.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, at, n = np.unique(pdf[["height", "area"]].to_numpy(float), axis=0, return_inverse=True, return_counts=True)
        label = fit(distinct, n.astype(float), k, restarts, seed)
        out = pdf.assign(cluster=label[at.ravel()].astype(np.int32))
        return out[out.cluster > label.max() - keep]

    cols = [c.split()[0] for c in SEGMENTS.split(", ")]
    return peaks.select(*cols).groupBy("contig", "sample").applyInPandas(run, f"{SEGMENTS}, cluster int")


def top_k(peaks: DataFrame, k: int, by: str = "height") -> DataFrame:
    w = Window.partitionBy("contig", "sample").orderBy(F.desc(by), "start")
    return peaks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
