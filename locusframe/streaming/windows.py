"""Streaming versions of tumbling windows and context averages (an extension of the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.bases import iupac_match, meth


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and sum of value a window and type; late rows within the watermark count."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def context_means(calls: DataFrame, patterns: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Sum and number of methylation levels a window and context of a stream of calls (ts, ctx, c, t, c_nonconv)."""
    level = meth(F.col("c"), F.col("t"), F.col("c_nonconv"))
    tagged = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("pattern", iupac_match(F.col("ctx"), patterns)).where("pattern IS NOT NULL")
    return tagged.groupBy(F.window("ts", width), "pattern").agg(F.count(level).alias("n"), F.sum(level).alias("total")).select(F.col("window.start").alias("start"), "pattern", "n", "total")
