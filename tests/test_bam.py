"""BAM against SAM text of the same alignments, in splits of any size."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import filters
from locusframe.sources import bam, fasta, text

REFS = [("c1", 5000), ("c2", 300), ("long_contig_name", 10**6)]


def lines(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        mapped = rng.random() < 0.9
        ops = [(rng.randint(1, 40), rng.choice("MIDNS=X")) for _ in range(rng.randint(1, 5))] if mapped else []
        size = sum(k for k, o in ops if o in "MIS=X") if ops else rng.randint(0, 60)
        bases = "".join(rng.choice("ACGTN") for _ in range(size)) or "*"
        quals = "*" if bases == "*" or rng.random() < 0.1 else "".join(chr(33 + rng.randint(0, 41)) for _ in bases)
        contig, at = (rng.choice(REFS)[0], rng.randint(1, 250)) if mapped else ("*", 0)
        mate = rng.choice([("=", 17), ("*", 0), ("c2", 9)]) if mapped else ("*", 0)
        flag = rng.choice([0, 16, 83, 99, 147, 163, 256 + 16, 512, 1024, 1, 65 + 8]) if mapped else 4
        tags = [t for t in (f"NH:i:{rng.choice([1, 2, 300, -5, 70000])}", f"RG:Z:g{i % 3}", "XT:A:R", "xf:f:0.25", "ZB:B:c,1,-2,3", "ZF:B:f,0.5,2", f"ZL:Z:{'long value ' * rng.randint(0, 300)}") if rng.random() < 0.5]
        out.append("\t".join([f"read{i}", str(flag), contig, str(at), str(rng.randint(0, 60)), "".join(f"{k}{o}" for k, o in ops) or "*", *map(str, mate), str(rng.randint(-500, 500)), bases, quals, *tags]))
    return out


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bam")
    (at / "x.sam").write_text("@HD\tVN:1.6\n" + "\n".join(lines(700)) + "\n")
    told = text.sam(spark, str(at / "x.sam"))
    bam.write(told.coalesce(2), str(at / "b"), REFS, block=1500)
    return told, str(at / "b")


def key(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("split", [1 << 25, 9000, 777, 100])
def test_bam_equals_sam(spark, both, split):
    told, path = both
    got = bam.read(spark, path, split)
    assert got.columns == told.columns
    assert key(got) == key(told)


def test_round_trip_and_header(spark, both, tmp_path):
    told, path = both
    bam.write(bam.read(spark, path), f"file://{tmp_path}/again", REFS)
    assert key(bam.read(spark, f"file://{tmp_path}/again", 3000)) == key(told)
    name, _ = bam.files(str(tmp_path / "again"))[0]
    head, references = bam.header(name)
    assert references == REFS and "@PG\tID:locusframe" in head and "SO:unsorted" in head


def test_filters_in_the_reader(spark, both):
    told, path = both
    got = bam.read(spark, path, 5000, {"unmapped": False, "not_primary": False}, 20, ["c1", "c2"])
    assert key(got) == key(told.where("NOT unmapped AND NOT not_primary AND mapq >= 20 AND contig IN ('c1', 'c2')"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        reads = bam.read(spark, path)
        keep = filters.engine(min_mapq=20, mate=True)
        pushed = reads.where(filters.mapped(F.col("unmapped"))).where(keep)
        assert key(pushed) == key(told.where("NOT unmapped").where(keep))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_long_header_and_records(spark, tmp_path):
    """A header over many blocks and records longer than a block or a range."""
    refs = [(f"contig{i:05d}", 100) for i in range(3000)]
    big = ["\t".join([f"r{i}", "0", "contig02999", "1", "60", f"{n}M", "*", "0", "0", "ACGT" * (n // 4), "*"]) for i, n in enumerate([40, 200_000, 40, 400_000, 8])]
    (tmp_path / "x.sam").write_text("\n".join(big) + "\n")
    told = text.sam(spark, str(tmp_path / "x.sam"))
    bam.write(told.coalesce(1), str(tmp_path / "b"), refs, block=4000)
    for split in (2000, 30_000, 1 << 25):
        assert key(bam.read(spark, str(tmp_path / "b"), split)) == key(told)


def test_empty(spark, both, tmp_path):
    told, _ = both
    bam.write(told.limit(0), str(tmp_path / "none"), REFS)
    assert bam.read(spark, str(tmp_path / "none")).count() == 0


def test_indexed_fasta(spark, tmp_path):
    """Chunks of any size, over line ends, equal the plain reader's sequences."""
    rng = random.Random(5)
    seqs = {"c1": "".join(rng.choice("acgtN") for _ in range(257)), "c2": "ACGT", "c3": "".join(rng.choice("ACGT") for _ in range(100))}
    text_, index, at = "", "", 0
    for name, seq in seqs.items():
        head = f">{name} described\n"
        lines_ = [seq[i : i + 50] for i in range(0, len(seq), 50)]
        index += f"{name}\t{len(seq)}\t{at + len(head)}\t50\t51\n"
        text_ += head + "\n".join(lines_) + "\n"
        at = len(text_)
    (tmp_path / "x.fa").write_text(text_)
    (tmp_path / "x.fa.fai").write_text(index)
    for chunk, per_task in ((7, 2), (50, 1), (1 << 16, 64)):
        rows = fasta.read(spark, str(tmp_path / "x.fa"), chunk=chunk, per_task=per_task).orderBy("contig", "chunk_start").collect()
        got = {}
        for r in rows:
            assert len(got.setdefault(r.contig, "")) == r.chunk_start - 1
            got[r.contig] += r.seq
        assert got == {k: v.upper() for k, v in seqs.items()}
    with pytest.raises(Exception, match="disagree"):
        (tmp_path / "x.fa.fai").write_text(index.replace("c1\t257", "c1\t290"))
        fasta.read(spark, str(tmp_path / "x.fa")).collect()


def test_records_in_batches(spark, tmp_path):
    """Records are made and read by columns; tags whose types come in another order, in part or not at all."""
    from pyspark.sql.datasource import DataSourceArrowWriter

    assert issubclass(bam.BamWriter, DataSourceArrowWriter)
    odd = [({"NH": "3", "XZ": "a b"}, {"XZ": "Z", "NH": "i"}), ({"NH": "-7", "RG": "g"}, {"NH": "i"}), ({"XZ": ""}, None), (None, None), ({"NH": "70000", "XA": "q", "RG": "h"}, {"NH": "i", "XA": "A", "RG": "Z"})]
    rows = [(f"r{i}", "c1", 5 + i, 60, [("M", 3), ("D", 2)], "AcR", [1, 2] if i % 2 else [1, 2, 3], a, t) for i, (a, t) in enumerate(odd)]
    frame = spark.createDataFrame(rows, "name string, contig string, start int, mapq int, cigar array<struct<op:string,len:int>>, bases string, quals array<int>, attrs map<string,string>, tag_types map<string,string>")
    empty = {k: F.lit(None) for k in bam.COLUMNS if k not in frame.columns}
    bam.write(frame.withColumns(empty).coalesce(1), str(tmp_path / "b"), REFS)
    got = {r.name: r for r in bam.read(spark, str(tmp_path / "b")).collect()}
    for i, (attrs, types) in enumerate(odd):
        r = got[f"r{i}"]
        assert r.attrs == (attrs or {}) and r.tag_types == {k: (types or {}).get(k, "Z") for k in attrs or {}} and r.read_group == (attrs or {}).get("RG")
        assert (r.start, r.end, r.mapq, r.bases, r.quals, r.mate_contig) == (5 + i, 9 + i, 60, "ACR", [] if i % 2 else [1, 2, 3], "*")
