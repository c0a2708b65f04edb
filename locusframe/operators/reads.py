"""Read-level quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import draws
from locusframe.operators.spans import ranked_all


def counter(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("n_reads"))


def inverted_pair_dups(reads: DataFrame) -> DataFrame:
    """Mapped reads, inverted duplicates among them, and their percentage, each counted for both ends."""
    inverted = F.col("first") & (F.col("st") == F.col("mate_st")) & (F.col("neg") == F.col("mate_neg"))
    out = reads.agg(F.count("*").alias("mapped"), F.count_if(inverted).alias("inverted"))
    return out.withColumn("pct", F.round(F.try_divide(F.lit(200.0) * F.col("inverted"), F.col("mapped").cast("double")), 6))


def base_quality(bases: DataFrame) -> DataFrame:
    """``base, cycle, qual`` (one row a base) to counts by the key base+cycle+quality."""
    return bases.groupBy("base", "cycle", "qual").agg(F.count("*").alias("n")).orderBy("base", "cycle", "qual")


def bases_of(reads: DataFrame) -> DataFrame:
    """One row a base, cycles from 1, of reads with arrays ``bases`` and ``quals``."""
    zipped = F.arrays_zip(F.split("bases", "").alias("base"), F.col("quals").alias("qual"))
    return reads.select(F.posexplode(zipped).alias("i", "x")).select(F.col("x.base").alias("base"), (F.col("i") + 1).alias("cycle"), F.col("x.qual").alias("qual"))


def nmers(sequences: DataFrame, k: int, parity: bool = False) -> DataFrame:
    """Counts of k-mers; ``parity`` leaves the last one of each sequence out.

    Sequences are ASCII and read as bytes, whose places need no walk from the start.
    """
    raw = F.col("raw")
    last = F.length(raw) - k + (0 if parity else 1)
    words = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(raw, i, F.lit(k)))
    found = sequences.select(F.col("seq").cast("binary").alias("raw")).where(last >= 1).select(F.explode(words).alias("nmer"))
    return found.groupBy("nmer").agg(F.count("*").alias("n")).select(F.col("nmer").cast("string").alias("nmer"), "n")


def read_length(cigar: DataFrame, skip: int = 1, order: str = "name") -> DataFrame:
    """``cigar``: array of (op, len).  Clips (S, H) count as events and bases and as length;
    M, D, P, I add length; N adds none; other operations are an error."""

    def total(ops: str, what):
        return F.aggregate(F.filter("cigar", lambda x: x["op"].isin(*ops)), F.lit(0), lambda s, x: s + what(x))

    bad = F.exists("cigar", lambda x: ~x["op"].isin(*"SHMDPIN"))
    length = F.when(bad, F.raise_error(F.lit("unknown CIGAR operation")).cast("int")).otherwise(total("SHMDPI", lambda x: x["len"]))
    out = cigar.withColumn("length", length).withColumn("events", total("SH", lambda _: F.lit(1))).withColumn("clipped", total("SH", lambda x: x["len"]))
    if skip > 1:
        out = ranked_all(out, [order], "_i").where(F.col("_i") % skip == 0)
    return length_summary(out)


def length_summary(rows: DataFrame) -> DataFrame:
    pct = F.try_divide(F.lit(100.0) * F.col("clipped"), F.col("length").cast("double"))
    stats = [s for name, col in (("length", F.col("length")), ("events", F.col("events")), ("clipped", F.col("clipped")), ("pct_clipped", pct)) for s in (F.round(F.avg(col), 6).alias(f"mean_{name}"), F.round(F.stddev_samp(col), 6).alias(f"sd_{name}"))]
    return rows.agg(F.count("*").alias("n"), *stats)


DUP_KEY = ["contig", "st", "paired", "mate_contig", "mate_st"]


def duplicate_keys(reads: DataFrame) -> DataFrame:
    """Reads that can be duplicates, with the key that duplicates share.

    Of pairs the forward end counts, with its mate's place; unpaired reads count on either
    strand, by their own place alone; a paired and an unpaired read are never duplicates.
    Without a column ``paired`` all reads are; without ``mate_contig`` mates are on the same contig.
    """
    paired = F.coalesce("paired", F.lit(False)) if "paired" in reads.columns else F.lit(True)
    mate = F.col("mate_contig") if "mate_contig" in reads.columns else F.col("contig")
    kept = reads.withColumn("paired", paired).where("NOT paired OR NOT neg")
    return kept.withColumn("mate_contig", F.when(F.col("paired"), mate)).withColumn("mate_st", F.when(F.col("paired"), F.col("mate_st")))


def dup_groups(reads: DataFrame) -> DataFrame:
    """Groups of duplicates, and the reads beyond the first of each."""
    groups = duplicate_keys(reads).groupBy(*DUP_KEY).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_dups"))


def downsample_dups(reads: DataFrame, p: float, trials: int, seed: int = 1) -> DataFrame:
    """Per trial, seeded sampling of eligible reads at rate p: sampled, duplicates, ratio.

    A read's draw comes from ``name``, ``cycle`` and the trial.  Trials are counted side by
    side in one grouping: a read goes along once, with a count for each trial.
    """
    drawn = [F.when(draws.uniform(seed, "name", "cycle", t) < p, 1).otherwise(0).cast("long").alias(f"t{t}") for t in range(1, trials + 1)]
    per = duplicate_keys(reads).select(*DUP_KEY, *drawn).groupBy(*DUP_KEY).agg(*[F.sum(f"t{t}").alias(f"t{t}") for t in range(1, trials + 1)])
    sums = per.agg(*[x for t in range(1, trials + 1) for x in (F.sum(f"t{t}").alias(f"s{t}"), F.sum(F.greatest(F.col(f"t{t}") - 1, F.lit(0).cast("long"))).alias(f"d{t}"))])
    rows = [F.struct(F.lit(t).alias("trial"), F.col(f"s{t}").alias("sampled"), F.col(f"d{t}").alias("dups")) for t in range(1, trials + 1)]
    out = sums.select(F.inline(F.array(*rows))).where("sampled > 0")
    return out.withColumn("ratio", F.round(F.try_divide(F.col("dups").cast("double"), F.col("sampled").cast("double")), 6))


def dup_curve(reads: DataFrame, rates: list[float]) -> DataFrame:
    """Exact expectation for each sampling rate: ``p, sampled, dups, ratio``, from how many
    groups have each size; what the mean over trials tends to."""
    sizes = duplicate_keys(reads).groupBy(*DUP_KEY).agg(F.count("*").alias("m")).groupBy("m").agg(F.count("*").alias("groups"))
    p, m, g = F.col("p"), F.col("m"), F.col("groups")
    each = sizes.withColumn("p", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    out = each.groupBy("p").agg(F.sum(g * m * p).alias("sampled"), F.sum(g * (m * p - 1 + F.pow(1 - p, m))).alias("dups"))
    return out.select("p", F.round("sampled", 4).alias("sampled"), F.round("dups", 4).alias("dups"), F.round(F.try_divide("dups", "sampled"), 6).alias("ratio"))


def fix_pair_flags(reads: DataFrame) -> DataFrame:
    """Set first and second of paired reads from the suffix of their names; another suffix is an error."""
    first, second = F.col("name").endswith("/1"), F.col("name").endswith("/2")
    bad = F.raise_error(F.concat(F.lit("no end in read name "), F.col("name"))).cast("boolean")
    fix = lambda own, old: F.when(~F.col("paired"), old).when(first | second, own).otherwise(bad)
    return reads.withColumn("first_of_pair", fix(first, F.col("first_of_pair"))).withColumn("second_of_pair", fix(second, F.col("second_of_pair")))


def every_nth(rows: DataFrame, n: int, order: str) -> DataFrame:
    return ranked_all(rows, [order], "_i").where(F.col("_i") % n == 0).drop("_i")
