"""Reads laid along their CIGAR: aligned blocks, pileups and cytosines in the order of the read.

A read's operations are walked once, as an array expression, to blocks of bases that lie
on the reference (M, = and X); insertions and soft clips move on in the read, deletions
and skips on the reference, hard clips and padding in neither.  Blocks meet reference
chunks in an equi-join on position bins and are compared piece by piece, so a base becomes
a row only where a row a base is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import bases

#: Positions of a bin in which blocks and reference chunks meet; a row that meets carries a bin's bases.
BIN = 1 << 8


def blocks_of(cigar: Column, start: Column) -> Column:
    """``array<struct<off, pos, len>>``: aligned stretches, ``off`` from 0 in the read, ``pos`` on the contig."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<off:bigint,pos:bigint,len:bigint>>")
    state = F.struct(zero.alias("off"), start.cast("long").alias("pos"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        size, on_both = x["len"].cast("long"), x["op"].isin("M", "=", "X")
        block = F.struct(s["off"].alias("off"), s["pos"].alias("pos"), size.alias("len"))
        return F.struct(
            (s["off"] + F.when(on_both | x["op"].isin("I", "S"), size).otherwise(zero)).alias("off"),
            (s["pos"] + F.when(on_both | x["op"].isin("D", "N"), size).otherwise(zero)).alias("pos"),
            F.when(on_both & (size > 0), F.concat(s["out"], F.array(block))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(cigar, state, step, lambda s: s["out"])


def blocks(reads: DataFrame) -> DataFrame:
    """One row a block of reads with ``st, cigar, bases``: their columns without the CIGAR, and
    ``off, pos, len``, and the read's ``size``.  Reads without operations have none."""
    kept = [c for c in reads.columns if c not in ("cigar", "off", "pos", "len", "size")]
    return reads.where("cigar IS NOT NULL").select(*kept, F.length("bases").alias("size"), F.inline(blocks_of(F.col("cigar"), F.col("st"))))


def pileup(reads: DataFrame) -> DataFrame:
    """One row a base that lies on the reference: ``contig, pos, name, neg, second, base, prev,
    next`` and ``off`` in the read; neighbours are those on the read, whatever their operation."""
    at = F.col("off") + F.col("i") + 1  # from 1, as substring counts
    letter = lambda where: F.nullif(F.upper(F.substring(F.col("bases"), where, F.lit(1))), F.lit(""))
    one = blocks(reads).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("i"))
    before = F.when(at > 1, letter((at - 1).cast("int")))
    return one.where(at <= F.col("size")).select(
        "contig", (F.col("pos") + F.col("i")).alias("pos"), "name", "neg", "second", letter(at.cast("int")).alias("base"), before.alias("prev"), letter((at + 1).cast("int")).alias("next"), (at - 1).alias("off"),
    )


def binned(reference: DataFrame) -> DataFrame:
    """Reference chunks cut at position bins: ``contig, _bin, _from, _to, _seq``, and the chunk's
    bases beside the piece, ``_before`` and ``_after`` (null at its ends).  A chunk is walked once."""
    c = reference.where("seq <> ''").select("contig", F.col("chunk_start").cast("long").alias("_start"), F.upper("seq").alias("_all"))
    lead = (BIN - F.expr(f"pmod(_start, {BIN})")).cast("int")
    rest = F.regexp_extract_all(F.substring(F.col("_all"), lead + 1, F.length("_all")), F.lit(f"(?s).{{1,{BIN}}}"), F.lit(0))
    c = c.select("contig", "_start", F.concat(F.array(F.substring(F.col("_all"), F.lit(1), lead)), rest).alias("_pieces"))
    c = c.select("contig", "_start", "_pieces", F.posexplode("_pieces").alias("_k", "_seq")).withColumn("_bin", F.expr(f"_start div {BIN} + _k"))
    low = F.greatest("_start", F.col("_bin") * BIN)
    beside = lambda by, side: side(F.get("_pieces", F.col("_k") + by), F.lit(1))
    return c.select("contig", "_bin", low.alias("_from"), (low + F.length("_seq") - 1).alias("_to"), "_seq", beside(-1, F.right).alias("_before"), beside(1, F.left).alias("_after"))


def on_reference(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Stretches of reads with the reference under them: the read's columns, ``size``, ``off,
    pos`` of the stretch's first base, ``piece`` and ``ref_piece`` of equal length.

    ``reference``: contig, chunk_start, seq; chunks don't overlap, of any length.  A stretch
    ends where a block or a chunk does; bases beyond all chunks are left out.
    """
    b = blocks(reads)
    b = b.select("*", F.explode(F.sequence(F.expr(f"pos div {BIN}"), F.expr(f"(pos + len - 1) div {BIN}"))).alias("_bin"))
    c = binned(reference).drop("_before", "_after")
    first, last = F.greatest("_from", F.col("pos")), F.least("_to", F.col("pos") + F.col("len") - 1)
    met = b.join(c, ["contig", "_bin"]).withColumn("_first", first).withColumn("_n", last - first + 1).where("_n > 0")
    off = F.col("off") + F.col("_first") - F.col("pos")
    cut = lambda text, start: F.upper(F.substring(text, (start + 1).cast("int"), F.col("_n").cast("int")))
    kept = [x for x in b.columns if x not in ("off", "pos", "len", "_bin")]
    return met.select(*kept, off.alias("off"), F.col("_first").alias("pos"), cut(F.col("bases"), off).alias("piece"), cut(F.col("_seq"), F.col("_first") - F.col("_from")).alias("ref_piece"))


def read_cytosines(reads: DataFrame, reference: DataFrame, min_conv: int = 0, cph: bool = True) -> DataFrame:
    """Cytosines along each read, as the read was sequenced from its strand:
    ``contig, pos, neg, name, second, cycle`` (from 1), ``c, t`` (0 or 1), ``context, converted``.

    A cytosine is a reference C under a C or T of the read, both on the read's strand; the
    first and the last base of a read have no context and don't count.  ``converted`` counts
    the T so far on the read, this one included; below ``min_conv`` cytosines are left out.
    A neighbour in ``context`` is the reference's base if the read agrees with it (a C also
    by T), else N; so it is where the read's neighbour isn't on the neighbouring position.
    Without ``cph`` the read's next base must be G.
    """
    pieces = on_reference(reads, reference)
    # the base before and the base after a stretch, if they lie on the next positions too
    order = Window.partitionBy("name", "second", "contig").orderBy("off")
    beyond = lambda c, go, place: go(F.substring(F.col(c), *place)).over(order)
    end = lambda c: F.col(c) + F.length("piece")
    joined = (F.lag(end("off")).over(order) == F.col("off")) & (F.lag(end("pos")).over(order) == F.col("pos"))
    follows = (F.lead("off").over(order) == end("off")) & (F.lead("pos").over(order) == end("pos"))
    framed = lambda c: F.concat(F.coalesce(F.when(joined, beyond(c, F.lag, (-1, 1))), F.lit(" ")), F.col(c), F.coalesce(F.when(follows, beyond(c, F.lead, (1, 1))), F.lit(" ")))
    pieces = pieces.where("piece <> ''").withColumn("b", framed("piece")).withColumn("r", framed("ref_piece"))
    places = F.filter(F.sequence(F.lit(1), F.length("piece")), lambda i: F.substring(F.col("r"), i + 1, F.lit(1)) == F.when(F.col("neg"), "G").otherwise("C"))
    rows = pieces.select("*", F.explode(places).alias("i"))
    letter = lambda c, by: F.substring(F.col(c), F.col("i") + 1 + by, F.lit(1))
    rows = rows.select(
        "contig", "name", "neg", "second", "size", "bases", (F.col("off") + F.col("i") - 1).alias("off"), (F.col("pos") + F.col("i") - 1).alias("pos"), letter("b", 0).alias("base"), letter("r", 0).alias("ref"),
        *[letter(c, by).alias(f"{c}{side}") for c in "br" for side, by in (("0", -1), ("1", 1))],
    )
    turn = lambda c: F.when(F.col("neg"), bases.complement(F.col(c))).otherwise(F.col(c))
    side = lambda k, ahead: F.when(F.col("neg") == ahead, F.col(f"{k}0")).otherwise(F.col(f"{k}1"))
    strand = lambda c: F.when(F.col("neg"), bases.complement(c)).otherwise(c)
    said = lambda ahead: (strand(side("b", ahead)), strand(side("r", ahead)))

    def agreed(base: Column, ref: Column) -> Column:
        return F.when((ref != " ") & ((base == ref) | ((ref == "C") & (base == "T"))), ref).otherwise("N")

    cycle = F.when(F.col("neg"), F.col("size") - F.col("off")).otherwise(F.col("off") + 1)
    # the read's next base, on its strand, whether on the reference or not
    ahead = F.nullif(F.upper(F.substring(F.col("bases"), F.when(F.col("neg"), F.col("off")).otherwise(F.col("off") + 2).cast("int"), F.lit(1))), F.lit(""))
    calls = rows.select(
        "contig", "pos", "neg", "name", "second", cycle.cast("int").alias("cycle"), "size", turn("base").alias("base"), turn("ref").alias("ref"),
        F.concat(agreed(*said(False)), F.lit("C"), agreed(*said(True))).alias("context"), strand(ahead).alias("following"),
    )
    calls = calls.where((F.col("ref") == "C") & F.col("base").isin("C", "T") & F.col("cycle").between(2, F.col("size") - 1))
    along = Window.partitionBy("name", "second", "contig").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    t = (F.col("base") == "T").cast("int")
    calls = calls.withColumn("converted", F.sum(t).over(along).cast("int")).where(F.col("converted") >= min_conv)
    if not cph:
        calls = calls.where("following = 'G'")
    return calls.select("contig", "pos", "neg", "name", "second", "cycle", (1 - t).alias("c"), t.alias("t"), "context", "converted")


def valid_cg(ag: Column, following: Column, c_nonconv: Column, use_nonconv: bool) -> Column:
    """Whether a read shows a CpG: neither A nor G at the cytosine, G next, and with
    ``use_nonconv`` no cytosine that the conversion filter held back."""
    ok = (ag == 0) & (following == "G")
    return F.coalesce(ok & (c_nonconv == 0) if use_nonconv else ok, F.lit(False))


def methylated(c: Column, c_nonconv: Column, use_nonconv: bool) -> Column:
    """A read's call at a cytosine; without ``use_nonconv`` held-back cytosines count as methylated."""
    return (c > 0) if use_nonconv else ((c > 0) | (c_nonconv > 0))


def valid_base(base: Column) -> Column:
    """A neighbour that was read: neither missing nor N."""
    return F.coalesce(base != "N", F.lit(False))
