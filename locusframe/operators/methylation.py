"""Methylation by context and by read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import bases, draws, filters
from locusframe.operators.spans import SPAN
from locusframe.operators.windows import in_rows, own

DEFAULT_CONTEXTS = ["HCG", "GCH", "HCA", "HCT", "HCC"]


def with_pattern(cyt: DataFrame, patterns: list[str], context: str = "ctx") -> DataFrame:
    return cyt.withColumn("pattern", bases.iupac_match(F.col(context), patterns))


def averages(cyt: DataFrame, patterns: list[str] = DEFAULT_CONTEXTS) -> DataFrame:
    """Unweighted mean methylation in percent of the cytosines in each context; other contexts aren't shown."""
    level = bases.meth(F.col("c"), F.col("t"), F.col("c_nonconv"))
    return with_pattern(cyt, patterns).where("pattern IS NOT NULL").groupBy("pattern").agg(F.count(level).alias("n"), F.round(F.avg(level) * 100, 6).alias("mean_pct"))


def averages_row(cyt: DataFrame, n_reads: DataFrame, patterns: list[str] = DEFAULT_CONTEXTS) -> DataFrame:
    """One row: number of reads and the mean of each context."""
    level = bases.meth(F.col("c"), F.col("t"), F.col("c_nonconv"))
    wide = with_pattern(cyt, patterns).agg(*[F.round(F.avg(F.when(F.col("pattern") == p, level)) * 100, 6).alias(f"pct_{p.lower()}") for p in patterns])
    return n_reads.crossJoin(F.broadcast(wide))


def read_levels(cr: DataFrame, patterns: list[str]) -> DataFrame:
    """``contig, rd, pattern, num, den`` of each read."""
    return with_pattern(cr, patterns).where("pattern IS NOT NULL").groupBy("contig", "rd", "pattern").agg(F.count_if("meth").alias("num"), F.count("*").alias("den"))


def fraction_by_context(cr: DataFrame, one: str = "HCG", two: str = "GCH", merge: bool = False, dense: bool = False) -> DataFrame:
    """How many reads have each pair of fractions in two contexts.  ``merge`` makes equal
    values one (1/2 and 2/4); ``dense`` also lists pairs that no read has."""
    per = with_pattern(cr, [one, two]).where("pattern IS NOT NULL").groupBy("contig", "rd")
    n = lambda p, meth: F.count_if((F.col("pattern") == p) & F.col("meth")) if meth else F.count_if(F.col("pattern") == p)
    per = per.agg(n(one, True).alias("num1"), n(one, False).alias("den1"), n(two, True).alias("num2"), n(two, False).alias("den2")).where("den1 > 0 AND den2 > 0")
    if merge:
        per = per.select(*[bases.reduced(F.col(f"num{i}"), F.col(f"den{i}")).alias(f"r{i}") for i in (1, 2)]).groupBy("r1", "r2").agg(F.count("*").alias("_n"))
        per = per.select(*[F.round(F.col(f"r{i}.num") / F.col(f"r{i}.den"), 9).alias(f"f{i}") for i in (1, 2)], "_n")
        keys = [["f1"], ["f2"]]
    else:
        keys = [["num1", "den1"], ["num2", "den2"]]
    out = per.groupBy(*keys[0], *keys[1]).agg((F.sum("_n") if merge else F.count("*")).alias("n_reads"))
    if dense:
        grid = out.select(*keys[0]).distinct().crossJoin(out.select(*keys[1]).distinct())
        out = grid.join(out, [*keys[0], *keys[1]], "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0).cast("long")))
    return out


def quadrants(cr: DataFrame, one: str = "HCG", two: str = "GCH", low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Reads by level in two contexts, low [0, low] or high (high, 1] in each; others have no vote."""
    per = with_pattern(cr, [one, two]).where("pattern IS NOT NULL").groupBy("contig", "rd").agg(
        *[F.avg(F.when(F.col("pattern") == p, F.col("meth").cast("int"))).alias(k) for p, k in ((one, "a"), (two, "b"))]
    )
    level = lambda c: F.when(F.col(c) <= low, "low").when(F.col(c) > high, "high")
    return per.withColumn("a_level", level("a")).withColumn("b_level", level("b")).where("a_level IS NOT NULL AND b_level IS NOT NULL").groupBy("a_level", "b_level").agg(F.count("*").alias("n_reads"))


def find_reads(cr: DataFrame, one: str = "HCG", two: str = "GCH", least: int = 1, range1=(0.0, 1.0), range2=(0.0, 1.0)) -> DataFrame:
    """Reads with enough cytosines and levels in range in both contexts, as the position of their middle cytosine."""
    tagged = with_pattern(cr, [one, two]).where("pattern IS NOT NULL")
    m = F.col("meth").cast("int")
    per = tagged.groupBy("contig", "rd").agg(
        F.sort_array(F.collect_list("pos")).alias("at"),
        F.count_if(F.col("pattern") == one).alias("n1"), F.count_if(F.col("pattern") == two).alias("n2"),
        F.avg(F.when(F.col("pattern") == one, m)).alias("f1"), F.avg(F.when(F.col("pattern") == two, m)).alias("f2"),
    ).where((F.col("n1") >= least) & (F.col("n2") >= least) & F.col("f1").between(*range1) & F.col("f2").between(*range2))
    n = F.size("at")
    return per.select("contig", "rd", F.col("at")[F.least(F.floor(n / 2 + 0.5).cast("int"), n - 1)].alias("pos"))


def context_track(cyt: DataFrame, keep_all: bool = False, coverage: bool = False) -> DataFrame:
    """Per-context track rows: whole percent, or the number of reads with ``coverage``."""
    out = with_pattern(cyt, ["HCH", "GCG"]) if not keep_all else cyt.withColumn("pattern", F.lit(None))
    level = bases.meth(F.col("c"), F.col("t"))
    value = (F.col("c") + F.col("t")) if coverage else bases.percent(level)
    return out.where(F.col("pattern").isNull() & level.isNotNull()).select("contig", "pos", "ctx", bases.strand_sign(F.col("neg")).alias("strand"), value.alias("value"), (F.col("c") + F.col("t")).alias("n_reads"))


def db_rows(cyt: DataFrame, min_reads: int = 1, min_level: float = 0.0) -> DataFrame:
    """Rows of the methylation table that pass the variant filter and the thresholds of non-CpG contexts."""
    total = F.col("c") + F.col("c_nonconv") + F.col("t") + F.col("ag")
    level = bases.meth(F.col("c"), F.col("t"), F.col("c_nonconv"))
    cpg = F.substring("ctx", 3, 1) == "G"
    keep = filters.passes_snp(F.col("opp_a"), F.col("opp_tot")) & filters.cph_output(cpg, total, F.coalesce(level, F.lit(0.0)), min_reads, min_level)
    return cyt.where(keep).select("contig", "pos", bases.strand_char(F.col("neg")).alias("strand"), total.alias("total"), "c", "c_nonconv", "t", "ag", "opp_tot", "opp_a", "ctx", F.round(level * 100, 6).alias("pct_meth"))


def weights(cyt: DataFrame, span: int = SPAN) -> DataFrame:
    """Distance to the cytosine before; a minus one right after a plus one takes the plus one's."""
    dealt, w = in_rows(cyt, 2, span=span)
    p1, p2 = F.lag("pos", 1).over(w), F.lag("pos", 2).over(w)
    pair = (F.col("pos") - p1 == 1) & F.col("neg") & ~F.lag("neg", 1).over(w)
    return own(dealt.withColumn("weight", F.when(p1.isNull(), None).when(pair, p1 - p2).otherwise(F.col("pos") - p1)))


def clamp_weight(weight):
    """Weights out of (0, 5000) count as 100; half of it is used."""
    return F.when((weight < 0) | (weight > 5000), 100).otherwise(weight) / 2


def count_cytosines(cyt: DataFrame, keys: list[str] | None = None, keep: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """How many cytosines, by the keys; ``more``: aggregates of one's own."""
    rows = cyt if keep is None else cyt.where(keep)
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in (more or {}).items()])


def summarise(rows: DataFrame, keys: list[str], value, weight=None, more: dict[str, Column] | None = None) -> DataFrame:
    """Count, mean, weighted mean, population deviation, smallest and largest of a value;
    ``more``: summaries of one's own, by name."""
    aggs = [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high")]
    if weight is not None:
        use = (weight > 0) & value.isNotNull()
        aggs.insert(2, F.round(F.try_divide(F.sum(F.when(use, weight * value)), F.sum(F.when(use, weight)).cast("double")), 6).alias("weighted_mean"))
    return rows.groupBy(*keys).agg(*aggs, *[c.alias(name) for name, c in (more or {}).items()])


def composite(cyt: DataFrame, keys: list[str], counters: tuple[str, ...] = ("c", "c_nonconv", "t", "ag", "opp_tot", "opp_a")) -> DataFrame:
    """One cytosine of many: the sums of their counters by the keys."""
    return cyt.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counters])


def thinned(cyt: DataFrame, p: float, seed: int = 1, keys: tuple[str, ...] = ("contig", "pos")) -> DataFrame:
    """Calls thinned to a share p of their reads, one draw a counter.

    Every kind of read on the cytosine's strand is thinned for itself.  Of the opposite
    strand only the total is: how many of those left say A is drawn at the share seen
    before; next bases (``next_total``, ``next_g``, where present) likewise.
    """
    draw = lambda c: draws.binomial(F.col(c), F.lit(p), seed, *keys, F.lit(c))
    out = cyt.withColumns({f"_{c}": draw(c) for c in ("c", "c_nonconv", "t", "ag")})
    for part, total in (("opp_a", "opp_tot"), ("next_g", "next_total")):
        if part in cyt.columns and total in cyt.columns:
            share = F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(total).cast("double")), F.lit(0.0))
            out = out.withColumn(f"_{total}", draw(total)).withColumn(f"_{part}", draws.binomial(F.col(f"_{total}"), share, seed, *keys, F.lit(part)))
    new = {c[1:]: F.col(c) for c in out.columns if c.startswith("_") and c[1:] in cyt.columns}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in cyt.columns])


def read_points(cr: DataFrame, least: dict[str, int]) -> DataFrame:
    """``contig, rd, pattern, pos, v``: the share methylated of each read in each context, at the
    middle of its cytosines there; only of reads with enough of them in every context."""
    tagged = with_pattern(cr, list(least)).where("pattern IS NOT NULL")
    middle = F.floor((F.min("pos") + F.max("pos")) / 2).cast("long")
    points = tagged.groupBy("contig", "rd", "pattern").agg(middle.alias("pos"), F.count("*").alias("n"), (F.count_if("meth") / F.count("*")).alias("v"))
    enough = F.coalesce(*[F.when(F.col("pattern") == p, F.col("n") >= k) for p, k in least.items()])
    points = points.where(enough)
    whole = points.groupBy("contig", "rd").agg(F.count("*").alias("_k")).where(F.col("_k") == len(least)).drop("_k")
    return points.join(whole, ["contig", "rd"], "left_semi").select("contig", "rd", "pattern", "pos", "v")


def quadrant_points(points: DataFrame, one: str, two: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """``contig, rd, quadrant, pos, v``: reads that are low or high in both contexts, as a point of
    full value at their middle in the first one; others have no vote."""
    per = points.groupBy("contig", "rd").agg(*[F.max(F.when(F.col("pattern") == p, F.col("v"))).alias(k) for p, k in ((one, "a"), (two, "b"))], F.max(F.when(F.col("pattern") == one, F.col("pos"))).alias("pos"))
    level = lambda c: F.when(F.col(c) <= low, "low").when(F.col(c) > high, "high")
    return per.withColumn("quadrant", F.concat(level("a"), F.lit("_"), level("b"))).where("quadrant IS NOT NULL").select("contig", "rd", "quadrant", "pos", F.lit(1.0).alias("v"))


def db_lines(cyt: DataFrame) -> DataFrame:
    """The methylation table's lines of 16 columns, from calls with ``next_g, next_total, next_ref,
    prev_ref`` and ``weight``; a file a contig when written by ``contig``."""
    two = lambda c: F.when(c.isNull(), "NaN").otherwise(F.format_string("%.2f", c.cast("double")))
    total = F.col("c") + F.col("c_nonconv") + F.col("t") + F.col("ag")
    next_g = F.try_divide(100.0 * F.col("next_g"), F.col("next_total").cast("double"))
    cols = [F.col("pos"), bases.strand_char(F.col("neg")), total, *[F.col(c) for c in ("c", "c_nonconv", "t", "ag", "opp_tot", "opp_a", "next_g", "next_total")], F.upper("next_ref"), F.upper("prev_ref"), two(100 * bases.meth(F.col("c"), F.col("t"))), two(next_g), two(F.col("weight"))]
    return cyt.select("contig", F.col("pos").alias("_o1"), F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value"))


def read_lines(calls: DataFrame, weight: float | None = None) -> DataFrame:
    """Lines of 14 columns, one a read and cytosine, from ``alignment.read_cytosines``."""
    say = lambda c: F.when(c == "G", "true").otherwise("false")
    prev, next_ = F.substring("context", 1, 1), F.substring("context", 3, 1)
    w = F.lit("NaN") if weight is None else F.format_string("%.2f", F.lit(weight))
    zero = F.lit(0)
    cols = [F.col("pos"), bases.strand_char(F.col("neg")), F.col("name"), F.col("c"), zero, F.col("t"), zero, zero, zero, say(prev), prev, say(next_), next_, w]
    return calls.select("contig", F.col("pos").alias("_o1"), F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value"))
