"""Pairs of cytosines at a distance: self joins bucketed by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.features import overlap
from locusframe.sources.shared import cut


def near_pairs(left: DataFrame, right: DataFrame, width: int, keys: list[str], within: Column | None = None, back: bool = False) -> DataFrame:
    """Rows a of left and b of right with equal keys and 0 < b.pos - a.pos < width.

    An equi-join on (keys, bucket); each a looks into its own bucket and the next one, or
    with ``back``, for few b, each b into its own and the one before.
    """
    own = F.expr(f"pos div {width}")
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns], (own if back else F.explode(F.array(own, own + 1))).alias("bucket"))
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns], (F.explode(F.array(own, own - 1)) if back else own).alias("bucket_b"))
    on = F.col("bucket") == F.col("bucket_b")
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    gap = F.col("b_pos") - F.col("a_pos")
    on = on & (gap > 0) & (gap < width)
    return a.join(b, on if within is None else on & within).withColumn("dist", gap - 1).drop("bucket", "bucket_b")


def histogram(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The six counts by distance."""
    a, b = F.col("a_meth"), F.col("b_meth")
    n = lambda c, name: F.count_if(c).alias(name)
    return pairs.groupBy(*(by or []), "dist").agg(n(a, "n_m"), n(~a, "n_u"), n(a & b, "n_mm"), n(a & ~b, "n_mu"), n(~a & b, "n_um"), n(~a & ~b, "n_uu"))


def same_read(cr: DataFrame, width: int) -> DataFrame:
    return histogram(near_pairs(cr, cr, width, ["contig", "rd"]))


def chosen(pairs: DataFrame, only_different: bool = False) -> DataFrame:
    """For each read at a, the reads at b that are paired with it: by read id, the first, and
    the second if the first is the same read; with ``only_different`` the first other read."""
    w = Window.partitionBy("a_contig", "a_pos", "a_rd", "b_pos").orderBy("b_rd")
    if only_different:
        return pairs.where("a_rd <> b_rd").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    out = pairs.withColumn("k", F.row_number().over(w)).withColumn("fr", F.first("b_rd").over(w))
    return out.where("k = 1 OR (k = 2 AND fr = a_rd)").drop("k", "fr")


def any_read(cr: DataFrame, width: int, only_different: bool = False) -> DataFrame:
    """Histogram of ``chosen`` over all pairs of near cytosines; a row a read and position.

    Reads at b enter by the two smallest ids there, and reads at a as counts: all of them
    pair with b's first read, but for that read itself, which is looked up by its id.
    Positions are summed up once, and reads are sent once, to meet the fewer b.
    """
    if only_different:
        cr = cr.where("rd IS NOT NULL")
    m = F.col("meth")
    k = F.row_number().over(Window.partitionBy("contig", "pos").orderBy("rd"))
    nth = lambda i: F.max(F.when(F.col("k") == i, F.struct("rd", "meth")))
    sites = cut(cr.withColumn("k", k).groupBy("contig", "pos").agg(F.count("*").alias("n"), F.count_if(m).alias("m"), F.count_if(~m).alias("u"), nth(1).alias("one"), nth(2).alias("two")))
    parts = near_pairs(sites.select("contig", "pos", "n", "m", "u"), sites.select("contig", "pos", F.col("one.meth").alias("meth")), width, ["contig"])
    parts = parts.select("dist", F.col("a_n").alias("n"), F.col("a_m").alias("m"), F.col("a_u").alias("u"), F.col("b_meth").alias("b"))
    own = near_pairs(cr.select("contig", "pos", "rd", "meth"), sites.select("contig", "pos", "one.rd", "one", "two"), width, ["contig", "rd"], back=True)
    one = lambda sign, b: F.struct(F.lit(sign).alias("n"), F.when(F.col("a_meth"), sign).otherwise(0).alias("m"), F.when(~F.col("a_meth"), sign).otherwise(0).alias("u"), F.col(f"b_{b}.meth").alias("b"))
    second = F.when(F.col("b_two").isNotNull(), one(1, "two"))
    turns = F.array_compact(F.array(second, *([one(-1, "one")] if only_different else [])))
    parts = parts.unionByName(own.select("dist", F.inline(turns)))
    total = lambda v, c, name: F.sum(F.when(c, F.col(v)).otherwise(0)).alias(name)
    b, any_ = F.col("b"), F.lit(True)
    six = [total("m", any_, "n_m"), total("u", any_, "n_u"), total("m", b, "n_mm"), total("m", ~b, "n_mu"), total("u", b, "n_um"), total("u", ~b, "n_uu")]
    return parts.groupBy("dist").agg(F.sum("n").alias("pairs"), *six).where("pairs > 0").drop("pairs")


def by_context(cr: DataFrame, width: int, origin: str, target: str) -> DataFrame:
    """Same-read pairs from one context to another, in either order of position."""
    a, b = cr.where(F.col("ctx") == origin), cr.where(F.col("ctx") == target)
    ahead = near_pairs(a, b, width, ["contig", "rd"]).select("dist", "a_meth", "b_meth")
    behind = near_pairs(b, a, width, ["contig", "rd"]).select("dist", F.col("b_meth").alias("a_meth"), F.col("a_meth").alias("b_meth"))
    return histogram(ahead.unionByName(behind))


def across_boundary(cr: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """Same-read pairs with exactly one cytosine in a feature, by the outer one's distance to the feature's edge."""
    sites = cr.select("pos").distinct()
    inside = overlap(sites, features.select("fs", "fe")).groupBy("pos").agg(F.min("fs").alias("fs"), F.max("fe").alias("fe"))
    flagged = cr.select("contig", "pos", "rd", "meth").join(inside, "pos", "left")
    p = near_pairs(flagged, flagged, width, ["contig", "rd"]).where(F.col("a_fs").isNotNull() != F.col("b_fs").isNotNull())
    edge = F.when(F.col("a_fs").isNull(), F.col("b_fs") - F.col("a_pos")).otherwise(F.col("b_pos") - F.col("a_fe"))
    return histogram(p.withColumn("dist", edge))


def same_strand(equal: bool = True) -> Column:
    """Pairs on one strand, or on both; for ``near_pairs``' ``within``, of cytosines with ``neg``."""
    return (F.col("a_neg") == F.col("b_neg")) if equal else (F.col("a_neg") != F.col("b_neg"))


def midpoint() -> Column:
    """Whole middle of a pair, halves up, exact at any position."""
    return F.expr("(a_pos + b_pos + 1) div 2")


#: Conditions of the cube: bits of a pair's mask.
SAME_READ, OTHER_READ, ONE_STRAND, TWO_STRANDS = 1, 2, 4, 8


def condition_cube(cr: DataFrame, width: int, origin: str = "WCG", target: str = "GCH") -> DataFrame:
    """Pairs from one context to another, in either order of position, under all conditions at
    once: ``reads`` (same, different), ``strands`` (any, same, opposite), the methylation of
    both ends (``first``, ``second``), ``dist`` and ``n``.

    Cytosines of both contexts meet once, summed up by position before they do: the pairs
    of different reads are all pairs less those on one read, which meet by read.  Each row
    carries a mask of its conditions and is summed by it before the conditions are spread out.
    """
    a, b = cr.where(F.col("ctx") == origin), cr.where(F.col("ctx") == target)
    level = lambda df: df.groupBy("contig", "pos", "neg").agg(F.count_if("meth").alias("m"), F.count_if(~F.col("meth")).alias("u"))
    counts = F.array(*[F.struct(F.lit(x == "m").alias("first"), F.lit(y == "m").alias("second"), (F.col(f"a_{x}") * F.col(f"b_{y}")).alias("n")) for x in "mu" for y in "mu"])
    strands = F.when(F.col("a_neg") == F.col("b_neg"), ONE_STRAND).otherwise(TWO_STRANDS)

    def both_ways(left: DataFrame, right: DataFrame, keys: list[str], rows: list[Column]) -> DataFrame:
        turn = {f"{x}_{c}": F.col(f"{y}_{c}") for x, y in ("ab", "ba") for c in left.columns}
        ahead = near_pairs(left, right, width, keys)
        behind = near_pairs(right, left, width, keys).withColumns(turn)
        return ahead.unionByName(behind).select("dist", *rows)

    everywhere = both_ways(level(a), level(b), ["contig"], [strands.alias("mask"), F.inline(counts)])
    own = [c for c in ("contig", "pos", "neg", "rd", "meth")]
    one = F.lit(1).cast("long").alias("n")
    same = both_ways(a.select(*own), b.select(*own), ["contig", "rd"], [strands.alias("mask"), F.col("a_meth").alias("first"), F.col("b_meth").alias("second"), one])
    parts = everywhere.withColumn("mask", F.col("mask") + OTHER_READ).unionByName(same.withColumn("mask", F.col("mask") + OTHER_READ).withColumn("n", -F.col("n"))).unionByName(same.withColumn("mask", F.col("mask") + SAME_READ))
    sums = parts.groupBy("dist", "mask", "first", "second").agg(F.sum("n").alias("n"))
    has = lambda bit: F.col("mask").bitwiseAND(F.lit(bit)) != 0
    kinds = F.array(F.lit("any"), F.when(has(ONE_STRAND), "same").otherwise("opposite"))
    out = sums.select(F.when(has(SAME_READ), "same").otherwise("different").alias("reads"), F.explode(kinds).alias("strands"), "first", "second", "dist", "n")
    return out.groupBy("reads", "strands", "first", "second", "dist").agg(F.sum("n").alias("n")).where("n > 0")
