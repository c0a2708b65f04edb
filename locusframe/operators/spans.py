"""Ordered computations over spans of positions, so that no task holds a contig.

Rows are dealt over spans; what a span has to know of those before it is a small table
(totals, or a state) or a halo of neighbouring rows that travel along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.sources.shared import cut

SPAN = 1 << 16


def span_of(pos: str, span: int = SPAN) -> Column:
    return F.floor(F.col(pos) / span)


def running(df: DataFrame, keys: list[str], order: list[str | Column], out: str, value: Column, how: str = "sum", before: bool = False, span: Column | None = None) -> DataFrame:
    """Add ``out``: sum or max of ``value`` over the key's rows up to this one, or ``before`` it.

    Spans rise with the order; their totals, a row a span, are carried along.  ``df`` is read twice.
    """
    fn = {"sum": F.sum, "max": F.max}[how]
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}[how]
    df = df.withColumn("_s", span if span is not None else span_of(order[0])).withColumn("_v", value)
    ahead = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_s").agg(fn("_v").alias("_t"))
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_s").alias("_of"), fn("_t").over(ahead).alias("_c"))
    here = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    on = F.col("_s").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = df.withColumn("_l", fn("_v").over(here)).join(totals, on)
    return met.withColumn(out, both(F.col("_l"), F.col("_c"))).drop("_s", "_v", "_l", "_c", "_of", *[f"_k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], out: str, span: Column | None = None) -> DataFrame:
    """Add ``out``: the row's number in its key, from 1."""
    return running(df, keys, order, out, F.lit(1).cast("long"), span=span)


def ranked_all(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Add ``out``: the row's number among all rows, from 1, equal ones in any order.

    Rows are dealt by ranges of the order and written, so that their parts stay; parts are
    counted and each gets the rows before it as an offset.  No window is without a key.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    return running(parts, [], order, out, F.lit(1).cast("long"), span=F.col("_part")).drop("_part")


def with_halo(df: DataFrame, keys: list[str], rank: str, back: int, ahead: int = 0, span: int = SPAN) -> DataFrame:
    """Rows dealt over spans of ranks (from 1) as ``_s``, the ``back`` last rows before a span and
    the ``ahead`` first ones behind it also with it; ``_own`` tells a span's own rows.

    A window over (keys, _s) in order of rank then sees that many neighbours of every own row.
    ``back`` and ``ahead`` may be longer than a span.
    """
    own = F.floor((F.col(rank) - 1) / span)
    first, last = F.floor((F.col(rank) - 1 - ahead) / span), F.floor((F.col(rank) - 1 + back) / span)
    spans = F.sequence(F.greatest(first, F.lit(0).cast("long")), last)
    return df.withColumn("_o", own).select("*", F.explode(spans).alias("_s")).withColumn("_own", F.col("_o") == F.col("_s")).drop("_o")
