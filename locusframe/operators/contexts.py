"""What reads say around a cytosine: counts by relative position, and what follows from them.

The reads of a cytosine's strand are laid along it, in its own direction, and counted: one
column a relative position and base.  Consensus strings, H and Y counts, next-base ratios
and the exclusion of CpH are expressions over these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import bases
from locusframe.operators import alignment


def around(reads: DataFrame, flank: int) -> DataFrame:
    """``contig, pos, name, neg, second, around``: of each base on the reference the read's bases
    from ``flank`` before to ``flank`` after it, blanks beyond the read's ends."""
    blank = " " * flank
    padded = reads.withColumn("_wide", F.concat(F.lit(blank), F.upper("bases"), F.lit(blank)))
    one = alignment.blocks(padded).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("i"))
    at = F.col("off") + F.col("i")
    piece = F.substring(F.col("_wide"), (at + 1).cast("int"), F.lit(2 * flank + 1))
    return one.where(at < F.col("size")).select("contig", (F.col("pos") + F.col("i")).alias("pos"), "name", "neg", "second", piece.alias("around"))


def name_of(rel: int, base: str) -> str:
    return f"n{'m' if rel < 0 else ''}{abs(rel)}_{base.lower()}"


def counts(seen: DataFrame, sites: DataFrame, flank: int) -> DataFrame:
    """``contig, pos, neg`` and for each relative position and base the reads of the cytosine's
    strand that show it (``n1_g``, ``nm1_a`` before it, ...).

    ``sites``: contig, pos, neg, any other columns, which stay.  A read is on the strand that
    was converted: its own, turned for second ends.  Sites without reads are left out.
    """
    kept = [c for c in sites.columns if c not in ("contig", "pos")]
    s = sites.select("contig", "pos", *[F.col(c).alias(f"_{c}") for c in kept])
    met = seen.join(s, ["contig", "pos"]).where(F.col("_neg") == bases.bisulfite_negative(F.col("neg"), F.col("second")))
    met = met.select("contig", "pos", *[F.col(f"_{c}").alias(c) for c in kept], "around")
    return tallied(met, ["contig", "pos", *kept], flank)


def tallied(met: DataFrame, keys: list[str], flank: int) -> DataFrame:
    """Counts by key (``neg`` among them) of the bases in ``around``, turned on the reverse strand."""
    rels = [rel for rel in range(-flank, flank + 1) if rel]
    along = met.select(*keys, F.when(F.col("neg"), bases.reverse_complement(F.col("around"))).otherwise(F.col("around")).alias("along"))
    letters = along.select(*keys, *[F.substring("along", rel + flank + 1, 1).alias(f"_at{i}") for i, rel in enumerate(rels)])
    return letters.groupBy(*keys).agg(*[F.count_if(F.col(f"_at{i}") == b).cast("int").alias(name_of(rel, b)) for i, rel in enumerate(rels) for b in "ACGT"])


def counts_on(reads: DataFrame, reference: DataFrame, flank: int) -> DataFrame:
    """``counts`` at the cytosines of the reference, with the reference's ``prev_ref`` and
    ``next_ref`` along the cytosine's strand; a chunk's first and last base are no sites.

    Blocks of reads meet the reference in position bins and only what covers a cytosine
    becomes a row; the bins' partitioning serves the counts too.
    """
    b = alignment.blocks(reads.withColumn("neg", bases.bisulfite_negative(F.col("neg"), F.col("second"))))
    b = b.withColumn("len", F.least("len", F.col("size") - F.col("off"))).where("len > 0")
    blank = F.lit(" " * flank)
    wide = F.substring(F.concat(blank, F.upper("bases"), blank), (F.col("off") + 1).cast("int"), (F.col("len") + 2 * flank).cast("int"))
    ends = F.sequence(F.expr(f"pos div {alignment.BIN}"), F.expr(f"(pos + len - 1) div {alignment.BIN}"))
    b = b.select("contig", "pos", "len", "neg", wide.alias("_wide"), F.explode(ends).alias("_bin"))
    first, last = F.greatest("_from", "pos"), F.least("_to", F.col("pos") + F.col("len") - 1)
    met = b.join(alignment.binned(reference), ["contig", "_bin"]).withColumn("_first", first).withColumn("_n", (last - first + 1).cast("int")).where("_n > 0")
    framed = F.concat(F.coalesce("_before", F.lit(" ")), F.col("_seq"), F.coalesce("_after", F.lit(" ")))
    part = lambda text, start, more: F.substring(text, (start + 1).cast("int"), F.col("_n") + more)
    met = met.select(
        "contig", "_bin", "neg", "_first", part(F.col("_wide"), F.col("_first") - F.col("pos"), 2 * flank).alias("_wide"), part(framed, F.col("_first") - F.col("_from"), 2).alias("_ref"),
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"),
    )
    ref = lambda by: F.substring(F.col("_ref"), F.col("_i") + 1 + by, F.lit(1))
    turned = lambda a, z: F.when(F.col("neg"), bases.complement(z)).otherwise(a)
    met = met.where((ref(0) == F.when(F.col("neg"), "G").otherwise("C")) & (ref(-1) != " ") & (ref(1) != " "))
    met = met.select(
        "contig", "_bin", (F.col("_first") + F.col("_i") - 1).alias("pos"), "neg", turned(ref(-1), ref(1)).alias("prev_ref"), turned(ref(1), ref(-1)).alias("next_ref"),
        F.substring(F.col("_wide"), F.col("_i"), F.lit(2 * flank + 1)).alias("around"),
    )
    return tallied(met, ["contig", "_bin", "pos", "neg", "prev_ref", "next_ref"], flank).drop("_bin")


def total(rel: int) -> Column:
    return sum((F.col(name_of(rel, b)) for b in "ACGT"), F.lit(0))


def h_count(rel: int) -> Column:
    return sum((F.col(name_of(rel, b)) for b in "ACT"), F.lit(0))


def y_count(rel: int) -> Column:
    return sum((F.col(name_of(rel, b)) for b in "CT"), F.lit(0))


def share(rel: int, base: str) -> Column:
    """Share of the reads at a relative position that show a base; null without any."""
    return F.try_divide(F.col(name_of(rel, base)).cast("double"), total(rel).cast("double"))


def is_cph(next_ref: Column, most: float = 0.5, only_reference: bool = False) -> Column:
    """Whether no G follows: by the reads that cover the next base if there are any (a share of
    G below ``most``), else by the reference."""
    by_reference = next_ref != "G"
    return by_reference if only_reference else F.coalesce(share(1, "G") < most, by_reference)


def passes_cph(next_ref: Column, output_cph: bool, most: float = 0.101) -> Column:
    """The filter of cytosines that G doesn't follow."""
    return F.lit(True) if output_cph else ~F.coalesce(is_cph(next_ref, most), F.lit(True))


def consensus(before: int, after: int, prev_ref: Column, next_ref: Column, least: float = 0.899, bisulfite: bool = True) -> Column:
    """The context as a string: beside the C the reference's base, where that is known, and
    elsewhere the commonest one, if ``least`` of the reads agree or none is there, else N.
    With ``bisulfite`` a T agrees with a C."""
    out = []
    for rel in range(-before, after + 1):
        if rel == 0:
            out.append(F.lit("C"))
            continue
        common = bases.most_frequent_base(*[F.col(name_of(rel, b)) for b in "ACGT"])
        ref = {-1: prev_ref, 1: next_ref}.get(rel)
        base = common if ref is None else F.when(F.coalesce(ref, F.lit("N")) != "N", F.upper(ref)).otherwise(common)
        agree = F.coalesce(*[F.when(base == b, F.col(name_of(rel, b)) + (F.col(name_of(rel, "T")) if bisulfite and b == "C" else 0)) for b in "ACGT"])
        part = F.try_divide(agree.cast("double"), total(rel).cast("double"))
        out.append(F.when(part.isNull() | (part >= least), base).otherwise("N"))
    return F.concat(*out)


# ---- the reference around called cytosines ----------------------------------------------


def flank_pieces(calls: DataFrame, reference: DataFrame, up: int, down: int) -> DataFrame:
    """The reference around calls as it lies there: the calls' columns, ``_first``, a position, and
    ``_piece``, the bases from it on; a piece for each position bin that the stretch touches."""
    low = F.col("pos") - F.when(F.col("neg"), down).otherwise(up)
    high = F.col("pos") + F.when(F.col("neg"), up).otherwise(down)
    size = alignment.BIN
    stretch = calls.withColumn("_low", low).withColumn("_high", high)
    stretch = stretch.select("*", F.explode(F.sequence(F.floor(F.col("_low") / size), F.floor(F.col("_high") / size))).alias("_bin"))
    met = stretch.join(alignment.binned(reference), ["contig", "_bin"])
    first, last = F.greatest("_from", "_low"), F.least("_to", "_high")
    piece = F.substring(F.col("_seq"), (first - F.col("_from") + 1).cast("int"), (last - first + 1).cast("int"))
    return met.where(first <= last).select(*calls.columns, first.alias("_first"), piece.alias("_piece"))


def flanks(calls: DataFrame, reference: DataFrame, up: int, down: int) -> DataFrame:
    """The reference around calls (``contig, pos, neg``; other columns stay) base by base, along
    the cytosine's strand: ``offset`` from -up to down, and ``base``.

    A call's stretch meets reference chunks in the position bins that it touches, so it may
    run over their borders; places without reference are left out.
    """
    met = flank_pieces(calls, reference, up, down)
    rows = met.select(*calls.columns, "_first", "_piece", F.explode(F.sequence(F.lit(0), F.length("_piece") - 1)).alias("_i"))
    here, letter = F.col("_first") + F.col("_i"), F.substring(F.col("_piece"), F.col("_i") + 1, F.lit(1))
    offset = F.when(F.col("neg"), F.col("pos") - here).otherwise(here - F.col("pos"))
    return rows.select(*calls.columns, offset.cast("int").alias("offset"), F.when(F.col("neg"), bases.complement(letter)).otherwise(letter).alias("base"))


def qualifying(calls: DataFrame, context: str, min_meth: int) -> DataFrame:
    """Calls in a context (ambiguity letters allowed) with enough methylated reads."""
    return calls.where(F.col("context").rlike(bases.iupac_regex(context)) & (F.col("c") >= min_meth))


def call_matrix(calls: DataFrame, reference: DataFrame, context: str = "HCH", up: int = 5, down: int = 5, min_meth: int = 2) -> DataFrame:
    """Counts of bases by offset around qualifying calls of both strands: ``offset, a, c, g, t``."""
    seen = flanks(qualifying(calls, context, min_meth).select("contig", "pos", "neg"), reference, up, down)
    return seen.groupBy("offset").agg(*[F.count_if(F.col("base") == b).alias(b.lower()) for b in "ACGT"])


def call_sequences(calls: DataFrame, reference: DataFrame, context: str = "HCH", up: int = 5, down: int = 5, min_meth: int = 2) -> DataFrame:
    """``contig, pos, strand, meth, seq`` of qualifying calls, along their strand, for FASTA."""
    seen = flank_pieces(qualifying(calls, context, min_meth).select("contig", "pos", "neg", F.col("c").alias("meth")), reference, up, down)
    pieces = F.sort_array(F.collect_list(F.struct("_first", "_piece")))  # a piece a bin
    out = seen.groupBy("contig", "pos", "neg", "meth").agg(F.array_join(F.transform(pieces, lambda x: x["_piece"]), "").alias("seq"))
    out = out.withColumn("seq", F.when(F.col("neg"), bases.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return out.select("contig", "pos", bases.strand_char(F.col("neg")).alias("strand"), "meth", "seq")


def fetch(intervals: DataFrame, reference: DataFrame) -> DataFrame:
    """The reference's sequence of intervals (``contig, st, en``; other columns stay) as ``seq``, in
    upper case.  Intervals that reach beyond the reference are left out.

    Intervals meet chunks in position bins; their pieces are put together by interval.
    """
    size = alignment.BIN
    keys = intervals.columns
    wide = intervals.select("*", F.explode(F.sequence(F.floor(F.col("st") / size), F.floor(F.col("en") / size))).alias("_bin"))
    met = wide.join(alignment.binned(reference), ["contig", "_bin"])
    first, last = F.greatest("_from", F.col("st")), F.least("_to", F.col("en"))
    piece = F.substring(F.col("_seq"), (first - F.col("_from") + 1).cast("int"), (last - first + 1).cast("int"))
    met = met.where(first <= last).select(*keys, F.struct(first.alias("at"), piece.alias("piece")).alias("_p"))
    out = met.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    out = out.withColumn("seq", F.array_join(F.transform("_p", lambda x: x["piece"]), "")).drop("_p")
    return out.where(F.length("seq") == F.col("en") - F.col("st") + 1)
