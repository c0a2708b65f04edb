"""Matrices in long form: (row, col, v), nulls for missing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.spans import ranked_all


def long_form(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("row"), F.posexplode(vec_col).alias("col", "v")).select("row", "col", F.when(~F.isnan("v"), F.col("v").cast("double")).alias("v"))


def row_stats(m: DataFrame, key: str = "row") -> DataFrame:
    return m.groupBy(key).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"), F.round(F.sum("v"), 6).alias("total"))


def spread(m: DataFrame, key: str = "row") -> DataFrame:
    """Smallest, largest, population variance and number of missing cells of each row or column."""
    return m.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.var_pop("v"), 6).alias("variance"), F.count_if(F.col("v").isNull()).alias("missing"))


def sum_all(m: DataFrame) -> DataFrame:
    return m.agg(F.round(F.sum("v"), 4).alias("total"))


def initial(n_rows: int, n_cols: int, value: float | None, like: DataFrame) -> DataFrame:
    """A matrix of one value."""
    spark = like.sparkSession
    return spark.range(n_rows).withColumnRenamed("id", "row").select("row", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("col"), F.lit(value).cast("double").alias("v"))


def downscale_rows(m: DataFrame, n_out: int, smooth: int = 0) -> DataFrame:
    """Fewer rows, as ``downscale`` does for columns, of a matrix as high as its last row; with
    ``smooth`` each is then the mean of itself and so many on either side."""
    sized = m.crossJoin(F.broadcast(m.agg(F.expr(f"(max(row) + 1) div {n_out}").alias("_f"))))  # one row
    own = F.expr("row div _f")
    cells = F.filter(F.array(own, F.when(F.col("row") % F.col("_f") == 0, own - 1)), lambda p: p.isNotNull() & (p >= 0) & (p < n_out))
    out = sized.select("col", F.explode(cells).alias("cell"), "v").groupBy("cell", "col").agg(F.avg("v").alias("v"))
    if smooth:
        near = F.sequence(F.greatest(F.col("cell") - smooth, F.lit(0).cast("long")), F.least(F.col("cell") + smooth, F.lit(n_out - 1).cast("long")))
        out = out.select(F.explode(near).alias("cell"), "col", "v").groupBy("cell", "col").agg(F.avg("v").alias("v"))
    return out.select("cell", "col", F.round("v", 6).alias("v"))


def downscale(m: DataFrame, n_in: int, n_out: int) -> DataFrame:
    """Fewer columns: cell p is the mean of columns p f to (p + 1) f, both ends included, f = n_in div n_out."""
    f = n_in // n_out
    own = F.expr(f"col div {f}").cast("int")
    cells = F.filter(F.array(own, F.when(F.col("col") % f == 0, own - 1)), lambda p: p.isNotNull() & (p >= 0) & (p < n_out))
    return m.select("row", F.explode(cells).alias("cell"), "v").groupBy("row", "cell").agg(F.round(F.avg("v"), 6).alias("v"))


def normalise(m: DataFrame) -> DataFrame:
    """Each cell over its row's sum."""
    return m.withColumn("v", F.round(F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("row"))), 6))


def clip(m: DataFrame, low: float, high: float) -> DataFrame:
    """Cells beyond the extremes take their value."""
    return m.withColumn("v", F.when(F.col("v").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col("v")))))


def fill(m: DataFrame, value: float) -> DataFrame:
    return m.withColumn("v", F.coalesce("v", F.lit(value)))


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Cell by cell: sum, mean (nulls skipped), product or quotient."""
    j = a.join(b.withColumnRenamed("v", "w"), ["row", "col"], "full")
    ops = {
        "sum": F.when(F.col("v").isNull() & F.col("w").isNull(), None).otherwise(F.coalesce("v", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))),
        "mean": F.when(F.col("v").isNull() | F.col("w").isNull(), F.coalesce("v", "w")).otherwise((F.col("v") + F.col("w")) / 2),
        "mul": F.col("v") * F.col("w"),
        "div": F.try_divide("v", "w"),
    }
    return j.select("row", "col", ops[op].alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def inverted(m: DataFrame, n_rows: int | Column, n_cols: int) -> DataFrame:
    """Both axes flipped."""
    return m.select((n_rows - 1 - F.col("row")).alias("row"), (n_cols - 1 - F.col("col")).alias("col"), "v")


def sort_rows(m: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Rank of rows by mean, rows without cells at -0.00001, ties by row; ``means`` (row, mean),
    such as ``exp_weighted_mean``, takes the place of the plain mean."""
    if means is None:
        means = m.groupBy("row").agg(F.avg("v").alias("mean"))
    keyed = means.select("row", F.coalesce(F.col("mean").cast("double"), F.lit(-1e-5)).alias("by"))
    return ranked_all(keyed, ["by", "row"], "rank").select("row", "rank")


def exp_weighted_mean(m: DataFrame, n_cols: int, floor: float, power: float) -> DataFrame:
    """Weights grow with the distance from the middle; the sum is divided by the count."""
    mid = (n_cols - 1) / 2
    w = F.pow(F.greatest(F.abs(F.col("col") - mid), F.lit(floor)), F.lit(power)) / floor**power
    return m.groupBy("row").agg(F.round(F.sum(F.col("v") * w) / F.count("v"), 6).alias("mean"))


def histogram_bins(rows: DataFrame, value, low: float, high: float, n: int) -> DataFrame:
    """n bins, right-closed, the first and last open-ended; counts and shares."""
    width = (high - low) / n
    b = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((value - low) / width) - 1)).cast("int")
    out = rows.where(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def wide(m: DataFrame, n_cols: int) -> DataFrame:
    """Dense rows, for sinks."""
    return m.groupBy("row").pivot("col", list(range(n_cols))).agg(F.first("v"))
