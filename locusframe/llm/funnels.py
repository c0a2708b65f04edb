"""Ordered funnel counting by an ordinal equi-join (operator 12); DataFrame functions only.

The events of a client at one time are a *moment*.  Every moment carries, for each kind,
how many occurrences of that kind the client has had up to and with it.  An attempt that
stands at a moment with count c of the wanted kind therefore goes on to the occurrence
with ordinal c + 1: an equi-join on (client, kind, ordinal), spread evenly however many
events a client has.  The counts of the excluded kind at both moments differ exactly if
such an event lies after the one and not after the other.

Counts run over short spans of time; the totals of spans run over a day and those of days
over a client, so the longest window holds a client's days or the events of one span.
Quantiles come from exact counts by duration, dealt over ranges of durations.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut
from locusframe.llm.prefix import running

#: name: (kinds in order, excluded kind).
FUNNELS: dict[str, tuple[list[str], str]] = {
    "A": (["view", "click", "view", "purchase"], "error"),
    "B": (["signup", "view", "click", "purchase"], "error"),
    "C": (["click", "click", "purchase", "view"], "signup"),
}
#: Microseconds: of a span, of a day, and of a range of durations.
SPAN, DAY, RANGE = 300 * 10**6, 86_400 * 10**6, 1 << 15


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whether with a zone or without one."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def moments(events: DataFrame, kinds: list[str]) -> DataFrame:
    """``client, at, is_<i>, n_<i>``: which kinds occur at the moment, and each one's count so far."""
    bit = reduce(lambda a, b: a.when(F.col("kind") == b[1], 1 << b[0]), enumerate(kinds), F.when(F.lit(False), 0))
    # one exchange serves the moments, the totals of spans and the counts within them
    dealt = events.select("client", "at", F.floor(F.col("at") / SPAN).alias("span"), bit.cast("long").alias("bit")).repartition("client", "span")
    here = dealt.groupBy("client", "span", "at").agg(F.bit_or("bit").alias("bits"))
    here = here.select("client", "span", "at", *[F.shiftright("bits", i).bitwiseAND(F.lit(1)).cast("long").alias(f"is_{i}") for i in range(len(kinds))])
    names = [f"is_{i}" for i in range(len(kinds))]
    spans = here.groupBy("client", "span").agg(*[F.sum(c).alias(c) for c in names]).withColumn("day", F.floor(F.col("span") * SPAN / DAY))
    days = spans.groupBy("client", "day").agg(*[F.sum(c).alias(c) for c in names])
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w, to: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{to}{c}") for c in names]
    days = days.select("client", "day", *so_far(ahead("client", "day"), "d_"))
    spans = spans.select("client", "day", "span", *so_far(ahead("client", "day", "span"), "s_")).join(days, ["client", "day"])
    spans = spans.select("client", "span", *[(F.col(f"d_{c}") + F.col(f"s_{c}")).alias(f"b_{c}") for c in names])
    within = Window.partitionBy("client", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    local = here.select("*", *[F.sum(c).over(within).alias(f"w_{c}") for c in names])
    met = local.join(spans, ["client", "span"])
    return met.select("client", "at", *names, *[(F.col(f"w_is_{i}") + F.col(f"b_is_{i}")).alias(f"n_{i}") for i in range(len(kinds))])


def attempts(events: DataFrame, funnels: Mapping[str, tuple[list[str], str]], within: int) -> DataFrame:
    """One row for each step that an attempt reaches: ``funnel, client, step, wait`` (null for the first)."""
    kinds = sorted({k for steps, out in funnels.values() for k in [*steps, out]})
    number, size = {k: i for i, k in enumerate(kinds)}, len(kinds)
    table = cut(moments(events, kinds))
    counts = [f"n_{i}" for i in range(size)]

    pick = lambda values: reduce(lambda a, b: a.when(F.col("funnel") == b[0], b[1]), values.items(), F.when(F.lit(False), None))
    bad = {n: number[out] for n, (_, out) in funnels.items()}
    last = max(len(steps) for steps, _ in funnels.values())
    wanted = {step: {n: number[steps[step - 1]] for n, (steps, _) in funnels.items() if len(steps) >= step} for step in range(2, last + 1)}
    later = lambda step: sorted({*bad.values(), *(i for s, on in wanted.items() if s >= step for i in on.values())})

    start = [F.when(F.col(f"is_{number[steps[0]]}") == 1, F.lit(name)) for name, (steps, _) in funnels.items()]
    now = table.select(F.explode(F.array_compact(F.array(*start))).alias("funnel"), "client", F.col("at").alias("first"), "at", *counts)
    reached = now.select("funnel", "client", F.lit(1).alias("step"), F.lit(None).cast("long").alias("wait"))
    for step, on in wanted.items():
        # only occurrences that an attempt may ask for, with the counts that are read from here on
        kinds_, left = sorted({*on.values()}), later(step + 1) if step < last else sorted({*bad.values()})
        one = [F.when(F.col(f"is_{i}") == 1, F.struct(F.lit(i).alias("kind"), F.col(f"n_{i}").alias("ordinal"))) for i in kinds_]
        found = table.select("client", "at", *[counts[i] for i in left], F.explode(F.array_compact(F.array(*one))).alias("k"))
        occurrences = found.select(F.col("client").alias("c_"), F.col("k.kind").alias("k_"), F.col("k.ordinal").alias("o_"), F.col("at").alias("at_"), *[F.col(counts[i]).alias(f"{counts[i]}_") for i in left])
        asked = now.where(F.col("funnel").isin(*on)).select("funnel", "client", "first", "at", pick({n: F.lit(i) for n, i in on.items()}).alias("k"), (pick({n: F.col(f"n_{i}") for n, i in on.items()}) + 1).alias("o"), pick({n: F.col(f"n_{i}") for n, i in bad.items()}).alias("out"))
        met = asked.join(occurrences, (F.col("client") == F.col("c_")) & (F.col("k") == F.col("k_")) & (F.col("o") == F.col("o_")))
        met = met.where((F.col("at_") - F.col("first") <= within) & (pick({n: F.col(f"n_{i}_") for n, i in bad.items()}) == F.col("out")))
        more = [F.col("first"), F.col("at_").alias("at"), *[F.col(f"{counts[i]}_").alias(counts[i]) for i in left]] if step < last else []
        now = cut(met.select("funnel", "client", (F.col("at_") - F.col("at")).alias("wait"), *more))
        reached = reached.unionByName(now.select("funnel", "client", F.lit(step).alias("step"), "wait"))
    return reached


def quantiles(waits: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Of ``keys, wait``, the ceil(percent * n / 100)-th smallest wait of each key."""
    counted = cut(waits.groupBy(*keys, "wait").agg(F.count("*").alias("n")))
    ranked = running(counted, keys, F.floor(F.col("wait") / RANGE), [F.col("wait")], F.col("n"), "rank")
    return ranked.where(F.col("rank") * 100 >= F.col("rank_total") * percent).groupBy(*keys).agg(F.min("wait").alias("quantile"))


def count(clicks: DataFrame, funnels: Mapping[str, tuple[list[str], str]] = FUNNELS, minutes: int = 5, percent: int = 25) -> DataFrame:
    """``funnel, client_id, n1 .. nK, deepest, t2 .. tK, same_depth`` of each client with attempts.

    ``clicks`` needs ``client_id, kind, arrived_at``; rows with a null in any of them are
    left out, repeated rows count once, kinds of no funnel are ignored, and events at equal
    times are at one moment, so neither is later than the other.  Other columns are
    ignored.  An empty table gives no rows.
    """
    events = clicks.select(F.col("client_id").alias("client"), F.col("kind").alias("kind"), micros(F.col("arrived_at")).alias("at")).dropna()
    events = events.where(F.col("kind").isin(*{k for steps, out in funnels.values() for k in [*steps, out]}))
    steps = range(2, max(len(s) for s, _ in funnels.values()) + 1)
    reached = attempts(events, funnels, minutes * 60 * 10**6)
    totals = reached.groupBy("funnel", "client").agg(*[F.count_if(F.col("step") == s).alias(f"n{s}") for s in [1, *steps]], F.max("step").alias("deepest"))
    found = quantiles(reached.where("step > 1"), ["funnel", "client", "step"], percent)
    times = found.groupBy("funnel", "client").agg(*[F.max(F.when(F.col("step") == s, F.col("quantile"))).alias(f"t{s}") for s in steps])
    out = cut(totals.join(times, ["funnel", "client"], "left"))
    # at most a row for each funnel and depth
    same = out.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    out = out.join(F.broadcast(same), ["funnel", "deepest"])
    return out.select("funnel", F.col("client").alias("client_id"), "n1", *[f"n{s}" for s in steps], "deepest", *[f"t{s}" for s in steps], "same_depth")


def oracle(funnels: Mapping[str, tuple[list[str], str]] = FUNNELS, minutes: int = 5, percent: int = 25) -> str:
    """The same counts as SQL, each step by an as-of join and exclusions by another."""
    parts = ["r AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS tm FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL)"]
    for name, (steps, out) in funnels.items():
        p = name.lower()
        parts.append(f"{p}1 AS (SELECT client_id, tm AS first, tm, NULL::BIGINT AS wait, 1 AS step FROM r WHERE kind = '{steps[0]}')")
        for i, kind in enumerate(steps[1:], 2):
            parts.append(f"{p}{i}n AS (SELECT a.client_id, a.first, a.tm AS prev, b.tm FROM {p}{i - 1} a ASOF JOIN (SELECT * FROM r WHERE kind = '{kind}') b ON a.client_id = b.client_id AND a.tm < b.tm)")
            parts.append(f"{p}{i}x AS (SELECT n.*, x.tm AS bad FROM {p}{i}n n ASOF LEFT JOIN (SELECT * FROM r WHERE kind = '{out}') x ON n.client_id = x.client_id AND n.prev < x.tm)")
            parts.append(f"{p}{i} AS (SELECT client_id, first, tm, tm - prev AS wait, {i} AS step FROM {p}{i}x WHERE tm - first <= {minutes * 60 * 10**6} AND (bad IS NULL OR bad > tm))")
    every = " UNION ALL ".join(f"SELECT '{name}' AS funnel, client_id, step, wait FROM {name.lower()}{i}" for name, (steps, _) in funnels.items() for i in range(1, len(steps) + 1))
    steps = range(2, max(len(s) for s, _ in funnels.values()) + 1)
    parts.append(f"every AS ({every})")
    parts.append(f"ranked AS (SELECT *, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY wait) AS k, count(*) OVER (PARTITION BY funnel, client_id, step) AS n FROM every)")
    counts = ", ".join(f"count(*) FILTER (step = {s}) AS n{s}" for s in [1, *steps])
    times = ", ".join(f"min(wait) FILTER (step = {s} AND k * 100 >= n * {percent}) AS t{s}" for s in steps)
    parts.append(f"g AS (SELECT funnel, client_id, {counts}, CAST(max(step) AS INT) AS deepest, {times} FROM ranked GROUP BY 1, 2)")
    return f"WITH {', '.join(parts)} SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM g"
