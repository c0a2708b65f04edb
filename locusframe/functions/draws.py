"""Seeded draws that depend on nothing but their keys: no state, the same in any order and at
any size, and the same in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Trials that are drawn at once; with chances up to a half no probability underflows.
PIECE = 256


def uniform(*keys: Column | str | int) -> Column:
    """In [0, 1), from the first 32 bits of the keys' digest."""
    text = F.concat_ws(":", *[(F.lit(str(k)) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Tables of chances that a worker holds, at most so many.
HELD: dict[tuple[int, float], np.ndarray] = {}
MOST_HELD = 1 << 14


def chances(n: int, q: float) -> np.ndarray:
    """Cumulative chances of 0 to n - 1 successes among n trials, n up to PIECE, q up to a half."""
    if (n, q) not in HELD:
        if len(HELD) >= MOST_HELD:
            HELD.clear()
        j = np.arange(1, n)
        HELD[n, q] = np.cumsum(np.cumprod(np.concatenate([[(1 - q) ** n], (n - j + 1) / j * q / (1 - q)])))
    return HELD[n, q]


def successes(n: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of the cumulative chances lie at or below u: the inverse of the distribution."""
    out = np.zeros(len(n), np.int64)
    order = np.lexsort((q, n))
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(n[order]) != 0) | (np.diff(q[order]) != 0), [True]])) if len(n) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        if n[own[0]] > 0 and q[own[0]] > 0:
            out[own] = np.searchsorted(chances(int(n[own[0]]), float(q[own[0]])), u[own], side="right")
    return out


def binomial(n: Column, p: Column, *keys: Column | str | int) -> Column:
    """Successes among n trials at chance p: one draw for every PIECE trials, whatever n is.

    The draws are expressions; looking them up among the cumulative chances, which many
    rows share, is done for a batch of rows at a time.  Null counts and chances give null;
    counts below 1 give 0.
    """

    @pandas_udf("long")
    def look_up(n: pd.Series, q: pd.Series, u: pd.Series) -> pd.Series:
        pieces = u.str.len().to_numpy(np.int64)
        row = np.repeat(np.arange(len(n)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n.to_numpy()[row] - number * PIECE, PIECE)
        found = successes(size, q.to_numpy()[row], np.concatenate([*u, []]).astype(float))
        return pd.Series(np.bincount(row, found, len(n)).astype(np.int64))

    n, p = n.cast("long"), p.cast("double")
    # what is certain needs no draw, and passes through as no trials
    sure = (n < 1) | (p <= 0) | (p >= 1) | n.isNull() | p.isNull()
    trials = F.when(sure, 0).otherwise(n).cast("long")
    pieces = F.when(trials > 0, F.sequence(F.lit(1).cast("long"), F.ceil(trials / PIECE).cast("long"))).otherwise(F.array().cast("array<long>"))
    k = look_up(trials, F.when(sure, 0.0).otherwise(F.least(p, 1 - p)), F.transform(pieces, lambda c: uniform(*keys, c)))
    certain = F.when(n.isNull() | p.isNull(), None).when((n < 1) | (p <= 0), F.lit(0).cast("long")).otherwise(n)
    return F.when(sure, certain).when(p > 0.5, n - k).otherwise(k)
