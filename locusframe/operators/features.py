"""Joins with genomic features and profiles aligned to their anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.spans import SPAN, running, span_of
from locusframe.sources.shared import cut


def overlap(points: DataFrame, features: DataFrame, flank: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Points within ``flank`` of a feature: an equi-join on position bins, one bin a point
    and every bin that a widened feature touches, so a pair meets once."""
    width = 2 * flank + 1024
    f = features.withColumn("_bin", F.explode(F.sequence(F.expr(f"CAST(floor((fs - {flank}) / {width}) AS BIGINT)"), F.expr(f"CAST(floor((fe + {flank}) / {width}) AS BIGINT)"))))
    p = points.withColumn("_bin", F.expr(f"CAST(floor(pos / {width}) AS BIGINT)"))
    return p.join(f, ["_bin", *(keys or [])]).where(F.col("pos").between(F.col("fs") - flank, F.col("fe") + flank)).drop("_bin")


def offset():
    """Distance from the strand-aware start, along the strand."""
    return F.when(F.col("strand") == "-", F.col("fe") - F.col("pos")).otherwise(F.col("pos") - F.col("fs"))


def profile(points: DataFrame, features: DataFrame, flank: int, bin_size: int, value, by: list[str] | None = None) -> DataFrame:
    """Mean value of each feature's bins; features without a strand are skipped."""
    met = overlap(points, features.where("strand <> '.'"), flank)
    met = met.withColumn("bin", F.floor(offset() / bin_size).cast("int")).withColumn("v", value)
    return met.groupBy(*(by or []), "fid", "bin").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def profile_columns(points: DataFrame, features: DataFrame, flank: int, columns: int, value, by: list[str] | None = None) -> DataFrame:
    """The profile in ``columns`` cells from ``flank`` before a feature's start to ``flank`` after it,
    along its strand; neighbouring cells share the place between them."""
    f = features.where("strand <> '.'")
    anchor = F.when(F.col("strand") == "-", F.col("fe")).otherwise(F.col("fs"))
    f = f.withColumn("_at", anchor).withColumn("fs", F.col("_at")).withColumn("fe", F.col("_at"))
    met = overlap(points, f, flank).withColumn("col", (offset() + flank).cast("int")).withColumn("v", value)
    step = 2 * flank // columns
    own = F.expr(f"col div {step}").cast("int")
    cells = F.filter(F.array(own, F.when(F.col("col") % step == 0, own - 1)), lambda p: p.isNotNull() & (p >= 0) & (p < columns))
    met = met.select(*(by or []), "fid", F.explode(cells).alias("cell"), "v")
    return met.groupBy(*(by or []), "fid", "cell").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def nearest(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Nearest feature of each point: of those that start at or before it the one that
    reaches furthest, or the first one after it.

    Features may nest and overlap.  Of features that cover a point the one that reaches
    furthest counts, else the nearest; ties go to the smaller id.  Running extremes stay within a span of
    positions; the spans' own, a small table, carry them along, so no task holds a key.
    """
    f = features.select(key, F.col("fs").cast("long").alias("at"), F.struct("fe", (-F.col("fid")).alias("back"), "fs").alias("l"), F.struct("fs", "fid", "fe").alias("r"), F.lit(None).cast("long").alias("pid"))
    none = [F.lit(None).cast(f.schema[c].dataType).alias(c) for c in "lr"]
    both = f.unionByName(points.select(key, F.col("pos").cast("long").alias("at"), *none, F.col("pid").cast("long").alias("pid"), F.lit(True).alias("_point")), allowMissingColumns=True)
    both = both.withColumn("_point", F.coalesce("_point", F.lit(False))).withColumn("_span", F.floor(F.col("at") / SPAN))

    up = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(key).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy(key, "_span").agg(F.max("l").alias("l"), F.min("r").alias("r"))
    spans = spans.select(F.col(key).alias("_key"), F.col("_span").alias("_of"), F.max("l").over(up).alias("_l"), F.min("r").over(down).alias("_r"))

    within = Window.partitionBy(key, "_span")
    both = both.withColumn("left", F.max("l").over(within.orderBy("at", "_point").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("right", F.min("r").over(within.orderBy(F.desc("at"), F.desc("_point")).rowsBetween(Window.unboundedPreceding, 0)))  # those behind the point
    met = both.where("_point").join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_of")), "left")
    left, right = F.greatest("left", "_l"), F.least("right", "_r")
    dist = lambda s: F.greatest(F.lit(0).cast("long"), s["fs"] - F.col("at"), F.col("at") - s["fe"]).alias("d")
    each = F.array_compact(F.array(F.when(left.isNotNull(), F.struct(dist(left), (-left["back"]).alias("fid"))), F.when(right.isNotNull(), F.struct(dist(right), right["fid"].alias("fid")))))
    met = met.where(F.size(each) > 0).withColumn("_best", F.array_min(each))
    return met.select("pid", key, F.col("at").alias("pos"), F.col("_best.fid").alias("fid"), F.col("_best.d").alias("distance"))


def sequence_matrix(sequences: DataFrame, motif: str, flank: int) -> DataFrame:
    """Counts of bases around every hit of a motif: one row an offset, one column a base.

    Sequences are ASCII and read as bytes, whose places need no walk from the start.
    """
    k = len(motif)
    raw = F.col("raw")
    begin = lambda hit: F.greatest(F.lit(1), hit - flank)
    starts = F.filter(F.sequence(F.lit(1), F.length(raw) - k + 1), lambda i: F.substring(raw, i, F.lit(k)) == F.lit(motif.encode()))
    cut = F.transform(starts, lambda hit: F.struct((begin(hit) - hit).alias("first"), F.substring(raw, begin(hit), hit + flank + 1 - begin(hit)).alias("piece")))
    hits = sequences.select(F.col("seq").cast("binary").alias("raw")).where(F.length("raw") >= k).select(F.inline(cut))
    around = hits.groupBy("first", "piece").agg(F.count("*").alias("n")).select("first", "piece", "n", F.posexplode(F.split(F.col("piece").cast("string"), "")).alias("i", "base"))
    around = around.select((F.col("first") + F.col("i")).alias("offset"), "base", "n").where("base <> ''")
    return around.groupBy("offset").agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).cast("long").alias(b.lower()) for b in "ACGT"])


def intervals(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap a region, each once.

    Regions are merged first.  Of disjoint regions a read can only meet the last one that
    begins no later than it ends; that one is carried along in order of position, so
    no read meets more than one region and no task holds a contig.
    """
    islands = merge_intervals(regions).select("contig", F.col("st").cast("long").alias("_at"), F.col("en").cast("long").alias("_reach"))
    rows = reads.select("contig", F.col("en").cast("long").alias("_at"), F.struct(*reads.columns).alias("_read"))
    both = rows.unionByName(islands, allowMissingColumns=True).withColumn("_is_read", F.col("_read").isNotNull())
    met = running(both, ["contig"], ["_at", "_is_read"], "_last", F.when(~F.col("_is_read"), F.struct("_at", "_reach")), "max", span=span_of("_at"))
    return met.where(F.col("_is_read") & (F.col("_last._reach") >= F.col("_read.st"))).select("_read.*")


def merge_intervals(regions: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("contig",), span: int = SPAN) -> DataFrame:
    """Gaps and islands: intervals that touch, or lie within ``gap``, become one."""
    rows = cut(regions.select(*keys, "st", "en"))
    new = running(rows, list(keys), ["st", "en"], "_reach", F.col("en"), "max", before=True, span=span_of("st", span))
    new = cut(new.select(*keys, "st", "en", F.when(F.col("_reach").isNull() | (F.col("st") > F.col("_reach") + 1 + gap), 1).otherwise(0).cast("long").alias("_new")))
    new = running(new, list(keys), ["st", "en"], "_island", F.col("_new"), span=span_of("st", span))
    return new.groupBy(*keys, "_island").agg(F.min("st").alias("st"), F.max("en").alias("en")).drop("_island")
