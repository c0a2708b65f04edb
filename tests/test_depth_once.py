"""Depth: events of reads are sent once, spans' totals are summed before they are sent."""

import random
import re

from locusframe.operators import coverage


def test_events_are_grouped_once(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), s, s + rng.randint(0, 30)) for s in (rng.randint(1, 170) for _ in range(80))]
    reads = spark.createDataFrame(rows, "contig string, st long, en long")
    runs = coverage.depth_runs(reads, spark.createDataFrame([("a", 205), ("b", 210), ("c", 40)], "contig string, len long"), span=16)
    assert len(re.findall(r"Aggregate \[contig#\d+, p#\d+L?\]", runs._jdf.queryExecution().optimizedPlan().toString())) == 1
    got = {(r.contig, p): r.depth for r in runs.collect() for p in range(r.st, r.en + 1)}
    assert got == {(c, p): sum(x == c and s <= p <= e for x, s, e in rows) for c, n in (("a", 205), ("b", 210), ("c", 40)) for p in range(1, n + 1)}
