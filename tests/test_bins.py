"""Reference chunks in position bins, and what is counted and fetched from them over the bins' borders."""

import random

from locusframe.operators import alignment, contexts

RNG = random.Random(11)
#: Two chunks that touch and one apart, of lengths that fit no bin.
CHUNKS = [("c", 5, "".join(RNG.choice("ACGTacgt") for _ in range(1000))), ("c", 1005, "CGTAC"), ("d", 256, "".join(RNG.choice("ACGT") for _ in range(513)))]
TURN = str.maketrans("ACGT", "TGCA")


def reference(spark):
    return spark.createDataFrame(CHUNKS, "contig string, chunk_start long, seq string")


def test_pieces_are_no_longer_than_a_bin(spark):
    rows = alignment.binned(reference(spark)).collect()
    assert max(len(r._seq) for r in rows) <= alignment.BIN <= 1 << 10  # each row of a join carries one
    for contig, start, seq in CHUNKS:
        own = sorted((r for r in rows if r.contig == contig and start <= r._from < start + len(seq)), key=lambda r: r._from)
        assert "".join(r._seq for r in own) == seq.upper()
        assert all(r._from // alignment.BIN == r._to // alignment.BIN == r._bin and r._to - r._from + 1 == len(r._seq) for r in own)
        assert [r._before for r in own] == [None, *[r._seq[-1] for r in own[:-1]]] and [r._after for r in own] == [*[r._seq[0] for r in own[1:]], None]


def test_counts_on_the_reference(spark):
    """One read a stretch over borders of bins and chunks, by a plain loop."""
    reads, want = [], {}
    at = {(c, s + i): x.upper() for c, s, seq in CHUNKS for i, x in enumerate(seq)}
    inner = {(c, s + i) for c, s, seq in CHUNKS for i in range(1, len(seq) - 1)}
    for k in range(60):
        st, n, neg, second = RNG.randint(1, 1000), RNG.randint(1, 300), RNG.random() < 0.5, RNG.random() < 0.5
        text = "".join(RNG.choice("ACGTN") for _ in range(n + 3))
        reads.append(("c", f"r{k}", st, neg, second, text, [("S", 2), ("M", n), ("I", 1)]))
        strand = neg != second
        for i in range(n):
            if ("c", st + i) in inner and at["c", st + i] == ("G" if strand else "C"):
                sides = (at["c", st + i - 1], at["c", st + i + 1])
                key = ("c", st + i, strand, *([x.translate(TURN) for x in sides[::-1]] if strand else sides))
                got = want.setdefault(key, {})
                for rel in (-2, -1, 1, 2):
                    o = 2 + i + (-rel if strand else rel)
                    base = text[o] if 0 <= o < len(text) else " "
                    name = contexts.name_of(rel, base.translate(TURN) if strand else base)
                    got[name] = got.get(name, 0) + 1
    frame = spark.createDataFrame(reads, "contig string, name string, st long, neg boolean, second boolean, bases string, cigar array<struct<op:string,len:int>>")
    rows = contexts.counts_on(frame, reference(spark), 2).collect()
    assert {(r.contig, r.pos, r.neg, r.prev_ref, r.next_ref) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        d = want[r.contig, r.pos, r.neg, r.prev_ref, r.next_ref]
        assert all(r[contexts.name_of(rel, b)] == d.get(contexts.name_of(rel, b), 0) for rel in (-2, -1, 1, 2) for b in "ACGT")


def test_sequences_around_calls_over_borders(spark):
    """Calls whose stretch meets two bins, or the end of all chunks, on both strands."""
    at = {(c, s + i): x.upper() for c, s, seq in CHUNKS for i, x in enumerate(seq)}
    calls = [("c", p, neg, "ACA", 3) for p in (6, 255, 256, 257, 512, 1004, 1009) for neg in (False, True)] + [("d", 768, True, "ACA", 2), ("d", 767, False, "ACA", 2)]
    frame = spark.createDataFrame(calls, "contig string, pos long, neg boolean, context string, c long")
    got = {(r.contig, r.pos, r.strand): (r.meth, r.seq) for r in contexts.call_sequences(frame, reference(spark), up=5, down=4).collect()}
    want = {}
    for c, p, neg, _, meth in calls:
        text = "".join(at.get((c, p + (-o if neg else o)), "") for o in range(-5, 5))
        want[c, p, "-" if neg else "+"] = (meth, text.translate(TURN) if neg else text)
    assert got == want
