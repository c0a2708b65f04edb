"""Running sums over huge groups without a task per group.

Rows are dealt by (group, leading digits of a uniform hexadecimal key), so a group that
holds a third of the table is spread over thousands of buckets; the totals of the
buckets, a small table, give each bucket its offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the key that make a bucket: at most 4096 a group.
DIGITS = 3


def seeded(seed: int | str, *parts: Column) -> Column:
    """A uniform key: md5 over the seed and the parts, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]).cast("binary"))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def running(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, out: str, how: str = "sum") -> DataFrame:
    """Add ``out``: the sum (or ``how="max"``) of ``value`` over the group's rows up to and with
    this one, by (bucket, order), and ``out_total``: the group's.  ``df`` is read twice: cut it.
    """
    fn = {"sum": F.sum, "max": F.max}[how]
    none = F.lit(0) if how == "sum" else F.lit(None)
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    keys = [*group, "_b"]
    totals = df.groupBy(*keys).agg(fn("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_o", F.coalesce(fn("_s").over(before), none))
    totals = totals.withColumn("_t", fn("_s").over(Window.partitionBy(*group))).drop("_s")
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_o", "_t")
    local = df.withColumn("_r", fn("_v").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    joined = local.join(totals, met)
    return joined.withColumn(out, F.col("_r") + F.col("_o") if how == "sum" else F.greatest("_r", "_o")).withColumn(f"{out}_total", F.col("_t")).drop("_b", "_v", "_r", "_o", "_t", *[f"_k{i}" for i in range(len(keys))])
