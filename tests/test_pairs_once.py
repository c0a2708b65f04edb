"""Pairs of any reads: reads meet the positions once, whatever is counted from them."""

import random

from locusframe.operators import pairs


def test_reads_are_joined_once(spark):
    rng = random.Random(3)
    rows = {(rng.choice("ab"), rng.randint(0, 120), rng.randint(1, 6)): rng.random() < 0.5 for _ in range(300)}
    frame = spark.createDataFrame([(*k, v) for k, v in rows.items()], "contig string, pos long, rd long, meth boolean")
    found = pairs.any_read(frame, 30, only_different=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2  # of positions, and of reads
    want = pairs.histogram(pairs.chosen(pairs.near_pairs(frame, frame, 30, ["contig"]), only_different=True))
    cols = ["dist", "n_m", "n_u", "n_mm", "n_mu", "n_um", "n_uu"]
    assert sorted(map(tuple, found.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_near_pairs_from_either_side(spark):
    rng = random.Random(4)
    frame = lambda n: spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 200)) for _ in range(n)], "contig string, pos long")
    a, b = frame(60), frame(15)
    key = lambda back: sorted(map(tuple, pairs.near_pairs(a, b, 25, ["contig"], back=back).collect()))
    assert key(True) == key(False)
