"""Depth over every locus, without a row per locus.

Reads are two events each; events are summed by position, and running sums give runs of
equal depth.  A contig's events are dealt over spans of positions whose totals, a small
table, carry the depth from span to span: no task holds a whole contig.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import draws

SPAN = 1 << 16


def depth_runs(reads: DataFrame, contigs: DataFrame, span: int = SPAN) -> DataFrame:
    """``contig, st, en, depth``: maximal stretches between events, from 1 to the contig's length."""
    starts = reads.select("contig", F.col("st").cast("long").alias("p"), F.lit(1).alias("d"))
    ends = reads.select("contig", (F.col("en") + 1).cast("long").alias("p"), F.lit(-1).alias("d"))
    # every span of a contig begins with an event, so that runs end within their span
    heads = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"CAST(len div {span} AS BIGINT)"))).alias("k"))
    heads = heads.select("contig", F.greatest(F.col("k") * span, F.lit(1).cast("long")).alias("p"), F.lit(0).alias("d"))
    span_ = F.expr(f"p div {span}")
    raw = starts.unionByName(ends).unionByName(heads)
    events = raw.groupBy("contig", "p").agg(F.sum("d").alias("d")).withColumn("k", span_)
    # straight from the reads, so that a row a span is sent, not the events once more
    totals = raw.groupBy("contig", span_.alias("k")).agg(F.sum("d").alias("s"))
    before = Window.partitionBy("contig").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("contig", "k", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("contig", "k").orderBy("p")
    runs = events.withColumn("run", F.sum("d").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("p").over(here))
    runs = runs.join(totals, ["contig", "k"]).join(contigs.select("contig", F.col("len").cast("long").alias("len")), "contig")
    end = F.least(F.coalesce(F.col("next") - 1, (F.col("k") + 1) * span - 1), F.col("len"))
    return runs.select("contig", F.col("p").alias("st"), end.alias("en"), (F.col("run") + F.col("base")).alias("depth")).where("en >= st")


def summary(runs: DataFrame) -> DataFrame:
    """Loci, mean, largest, sample deviation and sum of depth."""
    n, s, q = F.col("n"), F.col("total"), F.col("q")
    width = F.col("en") - F.col("st") + 1
    sums = runs.agg(
        F.sum(width).alias("n"),
        F.max("depth").alias("max_depth"),
        F.sum(F.col("depth") * width).alias("total"),
        F.sum((F.col("depth") * F.col("depth") * width).cast("double")).alias("q"),
    )
    return sums.select(
        n.cast("long").alias("n"),
        F.round(F.try_divide(s.cast("double"), n), 6).alias("mean_depth"),
        F.col("max_depth").cast("long").alias("max_depth"),
        F.round(F.sqrt(F.try_divide(q - s.cast("double") * s / n, n - 1)), 6).alias("sd_depth"),
        s.cast("long").alias("sum_depth"),
    )


def bins(runs: DataFrame, width: int, drop_last: bool = False) -> DataFrame:
    """Tumbling position bins: ``contig, bin, mean_depth, max_depth``; runs are cut at bin edges."""
    first, last = F.expr(f"(st - 1) div {width}"), F.expr(f"(en - 1) div {width}")
    cut = runs.select("contig", "st", "en", "depth", F.explode(F.sequence(first, last)).alias("bin"))
    n = F.least("en", (F.col("bin") + 1) * width) - F.greatest("st", F.col("bin") * width + 1) + 1
    out = cut.groupBy("contig", "bin").agg(F.sum(n).alias("loci"), F.sum(F.col("depth") * n).alias("total"), F.max("depth").cast("long").alias("max_depth"))
    if drop_last:  # a window that a contig's end cuts short isn't reported
        out = out.where(F.col("loci") == width)
    return out.select("contig", "bin", F.round(F.col("total") / F.col("loci"), 6).alias("mean_depth"), "max_depth")


def carried_windows(runs: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """The windows of a traversal that knows no contigs (parity): ``window, mean_depth``.

    A window ends before every position that ``width`` divides, so a contig's first one has
    a position less, and what a contig leaves over begins the next one's.  What the last
    contig leaves over isn't reported.  Contigs follow one another by name.
    """
    order = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)  # a row a contig
    ends = contigs.select("contig", F.expr(f"CAST(len AS BIGINT) div {width}").alias("ends")).withColumn("base", F.coalesce(F.sum("ends").over(order), F.lit(0)))
    total = ends.agg(F.sum("ends").alias("windows"))
    parts = runs.select("contig", "st", "en", "depth", F.explode(F.sequence(F.expr(f"st div {width}"), F.expr(f"en div {width}"))).alias("k")).join(ends.select("contig", "base"), "contig")
    n = F.least("en", (F.col("k") + 1) * width - 1) - F.greatest("st", F.col("k") * width) + 1
    out = parts.groupBy((F.col("base") + F.col("k")).alias("window")).agg((F.sum(F.col("depth") * n) / F.sum(n)).alias("mean_depth"))
    return out.crossJoin(F.broadcast(total)).where("window < windows").select("window", F.round("mean_depth", 6).alias("mean_depth"))


def window_stats(windows: DataFrame) -> DataFrame:
    """Number, mean, largest and sample deviation of window means."""
    v = F.col("mean_depth")
    return windows.agg(F.count(v).alias("n"), F.round(F.avg(v), 5).alias("mean"), F.round(F.max(v), 5).alias("most"), F.round(F.stddev_samp(v), 5).alias("sd"))


def window_ladder(windows: DataFrame, step: int = 2) -> DataFrame:
    """Percentiles of window means in hundredths: ``pct, depth``."""
    hist = windows.groupBy(F.floor(100 * F.col("mean_depth") + 0.5).alias("hundredths")).agg(F.count("*").alias("n"))
    return ladder(hist, step, "hundredths").select("pct", (F.col("hundredths") / 100).alias("depth"))


def histogram(runs: DataFrame) -> DataFrame:
    return runs.groupBy("depth").agg(F.sum(F.col("en") - F.col("st") + 1).cast("long").alias("n"))


def ladder(hist: DataFrame, step: int = 2, value: str = "depth", by: list[str] | None = None) -> DataFrame:
    """Smallest value with more than p percent of the count at or below it, p = step, 2 step, ... < 100."""
    keys = by or []
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row a distinct value
    cum = hist.withColumn("cum", F.sum("n").over(part.orderBy(value))).withColumn("total", F.sum("n").over(part))
    prev = F.col("cum") - F.col("n")
    # the percents between a value's cumulative counts
    lo, hi = F.floor(prev * 100 / F.col("total") / step).cast("int"), F.ceil(F.col("cum") * 100 / F.col("total") / step).cast("int")
    wide = cum.select(*keys, value, "cum", "total", F.explode(F.sequence(F.greatest(lo - 1, F.lit(1)), F.least(hi + 1, F.lit((99) // step)))).alias("i")).where(F.col("cum") * 100 > F.col("total") * F.col("i") * step)
    return wide.groupBy(*keys, (F.col("i") * step).alias("pct")).agg(F.min(value).alias(value))


def thinned(runs: DataFrame, target: int, targets: int, seed: int = 1) -> DataFrame:
    """Histogram ``step, depth, n`` of the coverage thinned to k * target of the total, for the
    ``targets`` first k below the total, and in a last step unthinned.

    A run of equal depth is thinned as one, by one draw (``draws.binomial``), so no locus and
    no base becomes a row: each locus's depth is binomial, loci of a run go together.
    """
    total = runs.agg(F.sum(F.col("depth") * (F.col("en") - F.col("st") + 1)).cast("long").alias("all_bp"))  # one row
    steps = runs.crossJoin(F.broadcast(total)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(targets + 1))))
    p = F.when(F.col("step") > targets, 1.0).otherwise(F.least(F.lit(1.0), F.col("step") * float(target) / F.col("all_bp")))
    steps = steps.withColumn("p", p).where((F.col("step") - 1) * F.lit(target).cast("long") < F.col("all_bp"))
    d = draws.binomial(F.col("depth"), F.col("p"), seed, "step", "contig", "st")
    return steps.groupBy("step", d.alias("depth")).agg(F.sum(F.col("en") - F.col("st") + 1).cast("long").alias("n"))


def downsampled(hist: DataFrame) -> DataFrame:
    """``step, n, sum_depth, max_depth`` of a histogram by step."""
    return hist.groupBy("step").agg(F.sum("n").alias("n"), F.sum(F.col("depth") * F.col("n")).cast("long").alias("sum_depth"), F.max("depth").cast("long").alias("max_depth"))


def exclusive(reads: DataFrame, span: int = SPAN) -> DataFrame:
    """Stretches that one read group alone covers: ``contig, st, en, rg, depth``.

    Reads are two events each, as for the depth.  A position's groups are told apart by four
    running sums: of reads, of their groups' numbers, and of the numbers' squares.  With n
    reads and sums s and q all groups are the same if and only if n q = s s, and then its
    number is s / n.  So stretches are found without a row a locus, whatever the number of groups.
    """
    groups = reads.select("rg").distinct().withColumn("g", F.dense_rank().over(Window.orderBy("rg")).cast("decimal(38,0)"))  # a row a group
    r = reads.join(F.broadcast(groups), "rg")
    event = lambda at, sign: r.select("contig", at.cast("long").alias("p"), F.lit(sign).cast("long").alias("n"), (F.col("g") * sign).cast("decimal(38,0)").alias("s"), (F.col("g") * F.col("g") * sign).cast("decimal(38,0)").alias("q"))
    sums = lambda how, cols: [how(c).alias(c) for c in cols]
    events = event(F.col("st"), 1).unionByName(event(F.col("en") + 1, -1)).groupBy("contig", "p").agg(*sums(F.sum, "nsq"))
    events = events.withColumn("k", F.expr(f"p div {span}"))
    totals = events.groupBy("contig", "k").agg(*sums(F.sum, "nsq"), F.min("p").alias("from"))
    before = Window.partitionBy("contig").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("contig").orderBy("k")
    totals = totals.select("contig", "k", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in "nsq"], F.lead("from").over(ahead).alias("after"))
    here = Window.partitionBy("contig", "k").orderBy("p")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    runs = events.select("contig", "k", "p", *[F.sum(c).over(upto).alias(c) for c in "nsq"], F.lead("p").over(here).alias("next")).join(totals, ["contig", "k"])
    n, s_, q = (F.col(c) + F.col(f"b{c}") for c in "nsq")
    runs = runs.select("contig", F.col("p").alias("st"), (F.coalesce("next", "after") - 1).alias("en"), n.cast("long").alias("depth"), F.try_divide(s_, n.cast("decimal(20,0)")).cast("decimal(38,0)").alias("g"), n.alias("n"), s_.alias("s"), q.alias("q"))
    alone = (F.col("n") > 0) & (F.col("n").cast("decimal(18,0)") * F.col("q").cast("decimal(20,0)") == F.col("s").cast("decimal(19,0)") * F.col("s").cast("decimal(19,0)"))
    return runs.where(alone).join(F.broadcast(groups), "g").select("contig", "st", "en", "rg", "depth")


def exclusive_summary(stretches: DataFrame) -> DataFrame:
    width = F.col("en") - F.col("st") + 1
    return stretches.groupBy("rg").agg(F.sum(width).cast("long").alias("n_loci"), F.round(F.sum(F.col("depth") * width) / F.sum(width), 6).alias("mean_depth"))


def exclusive_track(stretches: DataFrame) -> DataFrame:
    """A row a locus: depth with a sign that tells groups of even and odd number apart."""
    groups = stretches.select("rg").distinct()
    signs = groups.withColumn("sign", F.when(F.dense_rank().over(Window.orderBy("rg")) % 2 == 0, -1).otherwise(1))  # a row a group
    loci = stretches.select("contig", "rg", "depth", F.explode(F.sequence("st", "en")).alias("pos"))
    return loci.join(F.broadcast(signs), "rg").select("contig", "pos", (F.col("sign") * F.col("depth")).cast("long").alias("signed_depth"))
