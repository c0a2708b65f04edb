"""Sliding windows over cytosines in order of position.

Cytosines of a contig are dealt over spans.  Windows of a number of cytosines see the
last ones of the span before (``with_halo``); windows of a length see the positions before
their span, and of what lies further back the last cytosine, carried along by span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.spans import SPAN, ranked, span_of, with_halo


def in_rows(cyt: DataFrame, back: int, order: str = "pos", span: int = SPAN) -> tuple[DataFrame, Window]:
    """Cytosines with the ``back`` ones before each, and the window that sees them; keep rows ``_own``."""
    dealt = with_halo(ranked(cyt, ["contig"], [order], "_rank", span_of(order, span)), ["contig"], "_rank", back, span=span)
    return dealt, Window.partitionBy("contig", "_s").orderBy("_rank")


def own(dealt: DataFrame) -> DataFrame:
    return dealt.where("_own").drop("_own", "_s", "_rank")


def fixed(cyt: DataFrame, width: int, min_n: int, value: str = "level", weight: str = "weight", span: int = SPAN) -> DataFrame:
    """Windows that end at each cytosine: those nearer than ``width`` and the nearest one beyond.

    Nothing comes out before such a one exists.  The mean is weighted by spacing; values
    without weight or level don't count.
    """
    span = max(span, width)
    use = F.col(value).isNotNull() & (F.col(weight) > 0)
    rows = cyt.select("contig", "pos", F.when(use, F.col(value) * F.col(weight)).alias("num"), F.when(use, F.col(weight)).alias("den"))
    # positions just before a span go along with it
    spans = F.sequence(span_of("pos", span), F.floor((F.col("pos") + width) / span))
    dealt = rows.withColumn("_s", F.explode(spans)).withColumn("_own", span_of("pos", span) == F.col("_s"))
    # of those further back the last one, by span: a row a span
    row = F.struct("pos", "num", "den")
    far_back = rows.groupBy("contig", (F.floor((F.col("pos") + width) / span) + 1).alias("_s")).agg(F.max(row).alias("last"))
    needed = rows.select("contig", span_of("pos", span).alias("_s")).distinct()
    small = far_back.unionByName(needed, allowMissingColumns=True).groupBy("contig", "_s").agg(F.max("last").alias("last"))
    small = small.select("contig", "_s", F.max("last").over(Window.partitionBy("contig").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)).alias("carried"))
    w = Window.partitionBy("contig", "_s").orderBy("pos")
    near, far = w.rangeBetween(-(width - 1), 0), w.rangeBetween(Window.unboundedPreceding, -width)
    out = dealt.withColumn("n", F.count("*").over(near) + 1).withColumn("sn", F.sum("num").over(near)).withColumn("sd", F.sum("den").over(near)).withColumn("edge", F.max(row).over(far))
    out = out.where("_own").join(small, ["contig", "_s"]).withColumn("edge", F.greatest("edge", "carried"))
    total, size = F.coalesce("sn", F.lit(0.0)) + F.coalesce("edge.num", F.lit(0.0)), F.coalesce("sd", F.lit(0)) + F.coalesce("edge.den", F.lit(0))
    return out.where((F.col("edge.pos").isNotNull()) & (F.col("n") >= min_n)).select("contig", F.col("edge.pos").alias("start"), F.col("pos").alias("end"), "n", F.round(F.try_divide(total, size.cast("double")), 6).alias("mean"))


def variable(cyt: DataFrame, k: int, stretch: int, value: str = "level", weight: str = "weight", parity: bool = False, span: int = SPAN) -> DataFrame:
    """Windows of the last k cytosines, where the one before them is nearer than ``stretch``.

    ``parity`` takes the mean over that one too, though it is out of bounds.
    """
    use = F.col(value).isNotNull() & (F.col(weight) > 0)
    rows = cyt.select("contig", "pos", F.when(use, F.col(value) * F.col(weight)).alias("num"), F.when(use, F.col(weight)).alias("den"))
    dealt, w = in_rows(rows, k, span=span)
    last = w.rowsBetween(-k if parity else -(k - 1), 0)
    mean = F.try_divide(F.sum("num").over(last), F.sum("den").over(last).cast("double"))
    out = own(dealt.withColumn("start", F.lag("pos", k - 1).over(w)).withColumn("before", F.lag("pos", k).over(w)).withColumn("mean", F.round(mean, 6)))
    return out.where(F.col("pos") - F.col("before") < stretch).select("contig", "start", F.col("pos").alias("end"), "mean")


def by_condition(cyt: DataFrame, conditions: dict[str, Column], k: int, stretch: int, parity: bool = False, span: int = SPAN) -> DataFrame:
    """``variable`` for the cytosines of each condition apart; a cytosine may be in several.
    With ``parity`` every condition gets every cytosine."""
    wanted = F.array_compact(F.array(*[F.lit(name) if parity else F.when(when, F.lit(name)) for name, when in conditions.items()]))
    each = cyt.withColumn("condition", F.explode(wanted)).withColumn("contig", F.struct(F.col("condition"), F.col("contig")))
    return variable(each, k, stretch, span=span).select("contig.condition", F.col("contig.contig").alias("contig"), "start", "end", "mean")


def bedgraph(windows: DataFrame, span: int = SPAN) -> DataFrame:
    """Spans from midpoint to midpoint, each with the value of the window that begins it."""
    mid = F.floor((F.col("start") + F.col("end")) / 2 + 0.5).cast("long")
    dealt, w = in_rows(windows.withColumn("mid", mid), 1, "end", span)
    out = dealt.withColumn("span_start", F.lag("mid").over(w)).withColumn("value", F.lag("mean").over(w))
    return own(out).where("span_start IS NOT NULL").select("contig", "span_start", F.col("mid").alias("span_end"), "value")
