"""Strongest regions of a score track."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.spans import ranked, span_of
from locusframe.sources.shared import cut


def score_histogram(scores: DataFrame) -> DataFrame:
    """A thousand bins of scores in [0, 1]."""
    return scores.groupBy(F.least(F.lit(999), F.floor(F.col("score") * 1000)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cutoff(hist: DataFrame, top_percent: int) -> DataFrame:
    """Score above which the strongest ``top_percent`` lie, from the histogram's upper end."""
    w = Window.partitionBy(F.lit(0))
    above = hist.withColumn("above", F.sum("n").over(w.orderBy(F.desc("bin")))).withColumn("total", F.sum("n").over(w))
    need = F.floor(F.col("total") * top_percent / 100 + 0.5)
    return above.where(F.col("above") >= need).agg((F.max("bin") / 1000).alias("cutoff"))


def candidates(scores: DataFrame, window: int, least: float, span: int = 1 << 16) -> DataFrame:
    """``contig, pos, score`` of every row that is the best of some ``window`` rows in a row
    (the first of equals) and reaches ``least``.

    Rows are cut into blocks of ``window``.  The last ``window`` rows up to a row are the
    end of one block and the beginning of the next: two running maxima, met by number.
    """
    rows = cut(ranked(cut(scores.select("contig", "pos", "score")), ["contig"], ["pos", "score"], "rank", span_of("pos", span)))
    row = F.struct("score", (-F.col("rank")).alias("back"), "pos")
    block = Window.partitionBy("contig", F.floor((F.col("rank") - 1) / window))
    up = F.max(row).over(block.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    down = F.max(row).over(block.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    both = cut(rows.select("contig", "rank", up.alias("up"), down.alias("down")))
    met = both.select("contig", "rank", "up").join(both.select("contig", (F.col("rank") + window - 1).alias("rank"), "down"), ["contig", "rank"])
    best = met.select("contig", F.greatest("up", "down").alias("best")).where(F.col("best.score") >= least)
    return best.groupBy("contig", "best.pos", "best.score", "best.back").agg(F.lit(1)).select("contig", "pos", "score")


def centres(scores: DataFrame, window: int, least: float, span: int = 1 << 18) -> DataFrame:
    """``contig, pos, score`` of well-spaced maxima: of the candidates in order of position the
    first, and then each time the next one more than ``window`` behind.

    Which one that is depends on the one before, over the borders of spans.  But it is
    among the first ``window`` positions of a span or the first candidate after them, so a span's
    effect is a table of at most ``window`` + 1 rows; a scan over these tables tells
    where each span begins, and all spans then choose at once.
    """
    span = max(span, 2 * window)
    found = cut(candidates(scores, window, least).withColumn("span", span_of("pos", span)))

    def jumps(pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(pos, pos + window, side="right")

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pos = np.unique(pdf.pos.to_numpy())
        last, after = np.arange(len(pos)), jumps(pos)
        last = np.append(np.where(after < len(pos), after, last), len(pos))
        while (last[last] != last).any():
            last = last[last]
        near = int(np.searchsorted(pos, key[1] * span + window, side="right")) + 1
        return pd.DataFrame({"contig": key[0], "span": key[1], "pos": pos[:near], "last": pos[last[:-1]][:near]})

    def entries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for at, own in pdf.sort_values(["span", "pos"]).groupby("span", sort=True):
            out.append((key[0], at, last))
            fits = own.pos.to_numpy() > last + window if last is not None else np.ones(len(own), bool)
            if fits.any():
                last = int(own["last"].to_numpy()[fits.argmax()])
        return pd.DataFrame(out, columns=["contig", "span", "before"]).astype({"before": "Int64"})

    def chosen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "score"], ascending=[True, False]).drop_duplicates("pos")
        pos, before = pdf.pos.to_numpy(), pdf.before.iloc[0]
        after, at, keep = jumps(pos), 0 if pd.isna(before) else int(np.searchsorted(pos, int(before) + window, side="right")), []
        while at < len(pos):
            keep.append(at)
            at = after[at]
        return pdf.iloc[keep][["contig", "pos", "score"]]

    kind = found.schema["contig"].dataType.simpleString()
    starts = found.groupBy("contig", "span").applyInPandas(summary, f"contig {kind}, span long, pos long, last long").groupBy("contig").applyInPandas(entries, f"contig {kind}, span long, before long")
    return found.join(starts, ["contig", "span"]).groupBy("contig", "span").applyInPandas(chosen, f"contig {kind}, pos long, score double")
