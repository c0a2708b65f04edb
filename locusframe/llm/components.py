"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (longs).  Returns ``node, component``: the smallest node that links reach.

    Each round is written to the shared folder; the rounds grow with the logarithm of the
    longest path.  A node with very many edges costs one group in a map-side aggregate and
    a join that Spark may split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether each node is either a centre or tied to one centre: links u > v only."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return not seen.where("up > 1 OR (up = 1 AND low = 0)").take(1)
