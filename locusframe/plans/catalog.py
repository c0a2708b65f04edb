"""Every query of the engine with its SQL counterpart.

A query applies an operator to an adapter view of a driver table; the SQL is written
independently, over every locus where the operator works on runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import bases, draws, filters
from locusframe.operators import alignment, contexts, coverage, cytosines, features, matrix, methylation, nucleosome, pairs, peaks, reads, windows
from locusframe.plans import views, walkers
from locusframe.plans.views import with_views
from locusframe.sources import bam, sinks
from locusframe.sources.shared import cut, fresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# parameters of the queries
BIN, LADDER, TARGET, TARGETS = 500, 2, 400_000, 20
K, DUP_P, TRIALS = 6, 0.25, 3
CONTEXTS = ["HCG", "GCH", "HCA", "HCT", "HCC"]
FIXED_W, FIXED_N, VAR_K, VAR_STRETCH = 800, 3, 8, 1500
PAIR_W = 200
CUBE_W = 40
FLANK, FEATURE_BIN = 200, 20
MOTIF, MOTIF_FLANK = "ACG", 5
PEAK_BIN = 10


# what the ambiguity letters of the patterns match, written out
REGEX = {"HCG": "^[ACT]CG$", "GCH": "^GC[ACT]$", "HCA": "^[ACT]CA$", "HCT": "^[ACT]CT$", "HCC": "^[ACT]CC$", "HCH": "^[ACT]C[ACT]$", "GCG": "^GCG$"}


def cases(*patterns: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(ctx, '{REGEX[p]}') THEN '{p}'" for p in patterns) + " END"


def query(sql: str | None = None, views_: tuple[str, ...] = (), name: str = ""):
    """Register a query and, with ``sql``, its counterpart over the named views."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            head = with_views(*views_) if views_ else ""
            body = sql.strip()
            if head and body.startswith("WITH RECURSIVE "):
                ORACLE[key] = f"WITH RECURSIVE {head[5:]}, {body[15:]}"
            else:
                ORACLE[key] = f"{head}, {body[5:]}" if head and body.startswith("WITH ") else f"{head} {body}"
        return fn

    return add


# Reads laid along a CIGAR.  The SQL knows for each of a read's 46 bases how far its position
# lies behind the first one (-1: none), and walks no operations.
LAID = """WITH s AS (SELECT 'chr' || (id % 3) AS contig, id, seq, coalesce(sum(length(seq)) OVER (PARTITION BY id % 3 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM v_seq),
q AS (SELECT *, unnest(generate_series(0, length(seq) // 60 - 1)) AS k FROM s WHERE length(seq) >= 60),
w AS (SELECT contig, id || ':' || k AS name, CAST(base + 60 * k + 6 AS BIGINT) AS st, k % 3 = 1 AS neg, k % 4 = 3 AS second, k, substr(seq, 60 * k + 1, 60) AS piece FROM q),
v AS (SELECT *, 'ACG' || piece[6:17] || 'TG' || piece[18:27] || piece[32:39] || piece[46:54] || 'CA' AS raw FROM w),
u AS (SELECT *, CASE WHEN k % 2 = 1 THEN raw WHEN neg THEN replace(raw, 'G', 'A') ELSE replace(raw, 'C', 'T') END AS bases FROM v),
a AS (SELECT o, CASE WHEN o BETWEEN 3 AND 14 THEN o - 3 WHEN o BETWEEN 17 AND 26 THEN o - 5 WHEN o BETWEEN 27 AND 34 THEN o - 1 WHEN o BETWEEN 35 AND 43 THEN o + 5 ELSE -1 END AS d FROM generate_series(0, 45) AS g(o)),
b AS (SELECT contig, name, neg, second, o, d, CASE WHEN d >= 0 THEN st + d END AS pos, substr(bases, CAST(o + 1 AS INT), 1) AS base, CASE WHEN d >= 0 THEN substr(piece, CAST(d + 6 AS INT), 1) END AS ref FROM u, a)"""


# ---- coverage -------------------------------------------------------------------------

LOCI = """WITH loci AS (SELECT c.contig, p.pos, coalesce(d.depth, 0) AS depth
  FROM v_contigs c, unnest(generate_series(1, c.len)) AS p(pos)
  LEFT JOIN (SELECT contig, pos, count(*) AS depth FROM (SELECT contig, unnest(generate_series(st, en)) AS pos FROM v_reads) GROUP BY contig, pos) d
  ON d.contig = c.contig AND d.pos = p.pos)"""
LADDER_SQL = f"""h AS (SELECT depth, count(*) AS n FROM loci GROUP BY depth),
c AS (SELECT depth, sum(n) OVER (ORDER BY depth) AS cum, sum(n) OVER () AS total FROM h)
SELECT CAST(p.p AS INT) AS pct, CAST(min(depth) AS BIGINT) AS depth FROM c, generate_series({LADDER}, 98, {LADDER}) AS p(p) WHERE cum * 100 > total * p.p GROUP BY p.p"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.depth_runs(views.reads(spark, sf_dir), views.contigs(spark, sf_dir))


@query(
    f"""{LOCI} SELECT count(*) AS n, round(avg(depth), 6) AS mean_depth, CAST(max(depth) AS BIGINT) AS max_depth,
round(stddev_samp(depth), 6) AS sd_depth, CAST(sum(depth) AS BIGINT) AS sum_depth FROM loci""",
    ("v_contigs",),
)
def coverage_depth(spark, sf_dir):
    return coverage.summary(runs(spark, sf_dir))


@query(
    f"""{LOCI} SELECT contig, CAST((pos - 1) // {BIN} AS BIGINT) AS bin, round(avg(depth), 6) AS mean_depth, CAST(max(depth) AS BIGINT) AS max_depth
FROM loci GROUP BY 1, 2""",
    ("v_contigs",),
)
def bin_depths(spark, sf_dir):
    return coverage.bins(runs(spark, sf_dir), BIN)


@query(
    f"""{LOCI} SELECT contig, CAST((pos - 1) // {BIN} AS BIGINT) AS bin, round(avg(depth), 6) AS mean_depth, CAST(max(depth) AS BIGINT) AS max_depth
FROM loci GROUP BY 1, 2 HAVING count(*) = {BIN}""",
    ("v_contigs",),
)
def bin_depths_parity(spark, sf_dir):
    return coverage.bins(runs(spark, sf_dir), BIN, drop_last=True)


MEANS = f"""{LOCI}, wm AS (SELECT contig, (pos - 1) // {BIN} AS bin, round(avg(depth), 6) AS mean_depth FROM loci GROUP BY 1, 2)"""
CARRIED = f"""{LOCI}, ce AS (SELECT contig, len // {BIN} AS ends FROM v_contigs), cb AS (SELECT contig, coalesce(sum(ends) OVER (ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(ends) OVER () AS windows FROM ce),
wm AS (SELECT base + pos // {BIN} AS window_, round(avg(depth), 6) AS mean_depth FROM loci JOIN cb ON cb.contig = loci.contig WHERE base + pos // {BIN} < windows GROUP BY 1)"""
STATS_SQL = "SELECT count(*) AS n, round(avg(mean_depth), 5) AS mean, round(max(mean_depth), 5) AS most, round(stddev_samp(mean_depth), 5) AS sd FROM wm"
WINDOW_LADDER = f"""h AS (SELECT CAST(floor(100 * mean_depth + 0.5) AS BIGINT) AS v, count(*) AS n FROM wm GROUP BY 1), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total FROM h)
SELECT CAST(p.p AS INT) AS pct, min(v) / 100 AS depth FROM c, generate_series({LADDER}, 98, {LADDER}) AS p(p) WHERE cum * 100 > total * p.p GROUP BY p.p"""


@query(f"{MEANS} {STATS_SQL}", ("v_contigs",))
def bin_depths_stats(spark, sf_dir):
    return coverage.window_stats(coverage.bins(runs(spark, sf_dir), BIN))


@query(f"{MEANS}, {WINDOW_LADDER}", ("v_contigs",))
def bin_depths_window_percentiles(spark, sf_dir):
    return coverage.window_ladder(coverage.bins(runs(spark, sf_dir), BIN), LADDER)


@query(f"{CARRIED} {STATS_SQL}", ("v_contigs",))
def bin_depths_carried_stats(spark, sf_dir):
    return coverage.window_stats(coverage.carried_windows(runs(spark, sf_dir), views.contigs(spark, sf_dir), BIN))


@query(f"{CARRIED}, {WINDOW_LADDER}", ("v_contigs",))
def bin_depths_carried_percentiles(spark, sf_dir):
    return coverage.window_ladder(coverage.carried_windows(runs(spark, sf_dir), views.contigs(spark, sf_dir), BIN), LADDER)


@query(f"{LOCI}, {LADDER_SQL}", ("v_contigs",))
def bin_depths_percentiles(spark, sf_dir):
    return coverage.ladder(coverage.histogram(runs(spark, sf_dir)), LADDER)


# A run lies between places where reads begin or have ended; its draw comes from md5.
THINNED = f"""{LOCI}, ev AS (SELECT contig, 1::BIGINT AS p FROM v_contigs UNION SELECT contig, st FROM v_reads UNION SELECT contig, en + 1 FROM v_reads),
ru AS (SELECT e.contig, e.p AS st, coalesce(lead(e.p) OVER (PARTITION BY e.contig ORDER BY e.p) - 1, c.len) AS en FROM ev e JOIN v_contigs c ON c.contig = e.contig WHERE e.p <= c.len),
rd AS (SELECT r.contig, r.st, r.en - r.st + 1 AS width, l.depth FROM ru r JOIN loci l ON l.contig = r.contig AND l.pos = r.st),
bp AS (SELECT sum(depth * width) AS bp FROM rd),
st AS (SELECT s.s AS step, CASE WHEN s.s > {TARGETS} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, s.s * {float(TARGET)}::DOUBLE / bp) END AS p FROM bp, generate_series(1, {TARGETS + 1}) AS s(s) WHERE (s.s - 1) * {TARGET} < bp),
dr AS (SELECT step, p, least(p, 1 - p) AS q, contig, st, width, depth, c.c AS piece, least({draws.PIECE}, depth - (c.c - 1) * {draws.PIECE}) AS size, CAST('0x' || substr(md5('1:' || step || ':' || contig || ':' || st || ':' || c.c), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM rd, st, LATERAL (SELECT unnest(generate_series(1, greatest(1, (depth + {draws.PIECE - 1}) // {draws.PIECE}))) AS c) c),
pm AS (SELECT step, q, size, 0::BIGINT AS j, (1 - q) ** size AS pmf, (1 - q) ** size AS cdf FROM (SELECT DISTINCT step, q, size FROM dr WHERE size > 0 AND p < 1)
  UNION ALL SELECT step, q, size, j + 1, pmf * (size - j) / (j + 1) * q / (1 - q), cdf + pmf * (size - j) / (j + 1) * q / (1 - q) FROM pm WHERE j + 1 < size),
kk AS (SELECT d.step, d.contig, d.st, d.width, d.depth, d.p, d.piece, count(m.j) AS k FROM dr d LEFT JOIN pm m ON m.step = d.step AND m.size = d.size AND d.p < 1 AND m.cdf <= d.u GROUP BY ALL),
th AS (SELECT step, contig, st, width, CASE WHEN depth < 1 THEN 0 WHEN p >= 1 THEN depth WHEN p > 0.5 THEN depth - sum(k) ELSE sum(k) END AS depth FROM kk GROUP BY step, contig, st, width, depth, p)""".replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{THINNED} SELECT CAST(step AS INT) AS step, CAST(sum(width) AS BIGINT) AS n, CAST(sum(depth * width) AS BIGINT) AS sum_depth, CAST(max(depth) AS BIGINT) AS max_depth FROM th GROUP BY step", ("v_contigs",))
def downsample_coverage(spark, sf_dir):
    return coverage.downsampled(coverage.thinned(runs(spark, sf_dir), TARGET, TARGETS))


@query(
    f"""{THINNED}, th2 AS (SELECT step, depth, sum(width) AS n FROM th GROUP BY 1, 2), tc AS (SELECT step, depth, sum(n) OVER (PARTITION BY step ORDER BY depth) AS cum, sum(n) OVER (PARTITION BY step) AS total FROM th2)
SELECT CAST(step AS INT) AS step, CAST(p.p AS INT) AS pct, CAST(min(depth) AS BIGINT) AS depth FROM tc, generate_series({LADDER}, 98, {LADDER}) AS p(p) WHERE cum * 100 > total * p.p GROUP BY step, p.p""",
    ("v_contigs",),
)
def downsample_coverage_percentiles(spark, sf_dir):
    return coverage.ladder(coverage.thinned(runs(spark, sf_dir), TARGET, TARGETS), LADDER, by=["step"])


EXCLUSIVE = """WITH e AS (SELECT contig, pos, min(rg) AS rg, count(*) AS depth FROM (SELECT contig, rg, unnest(generate_series(st, en)) AS pos FROM v_reads)
GROUP BY contig, pos HAVING count(DISTINCT rg) = 1)"""


@query(f"{EXCLUSIVE} SELECT contig, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN dense_rank() OVER (ORDER BY rg) % 2 = 0 THEN -depth ELSE depth END AS BIGINT) AS signed_depth FROM e", ("v_reads",))
def exclusive_read_group(spark, sf_dir):
    return coverage.exclusive_track(coverage.exclusive(views.reads(spark, sf_dir)))


@query(f"{EXCLUSIVE} SELECT rg, count(*) AS n_loci, round(avg(depth), 6) AS mean_depth FROM e GROUP BY rg", ("v_reads",))
def exclusive_read_group_summary(spark, sf_dir):
    return coverage.exclusive_summary(coverage.exclusive(views.reads(spark, sf_dir)))


# ---- reads ----------------------------------------------------------------------------


@query("SELECT count(*) AS n_reads FROM v_reads WHERE mapq >= 20", ("v_reads",))
def read_counter(spark, sf_dir):
    return reads.counter(views.reads(spark, sf_dir).where(filters.mapping_quality(F.col("mapq"), 20)))


@query(
    """WITH k AS (SELECT count(*) AS mapped, count(*) FILTER (first AND st = mate_st AND neg = mate_neg) AS inverted FROM v_reads)
SELECT mapped, inverted, round(200.0::DOUBLE * inverted / mapped, 6) AS pct FROM k""",
    ("v_reads",),
)
def inverted_pair_dups(spark, sf_dir):
    return reads.inverted_pair_dups(views.reads(spark, sf_dir))


@query("SELECT contig, count(*) AS n FROM v_reads WHERE NOT (not_primary OR mapq < 30) GROUP BY contig", ("v_reads",))
def read_filters_nonunique(spark, sf_dir):
    r = views.reads(spark, sf_dir).where(filters.unique(F.col("not_primary"), F.when(F.col("mapq") < 30, "R")))
    return r.groupBy("contig").agg(F.count("*").alias("n"))


@query("SELECT contig, count(*) AS n FROM v_reads WHERE NOT not_primary AND NOT coalesce(CASE WHEN mapq < 70 THEN mapq // 20 END <> 1, false) GROUP BY contig", ("v_reads",))
def read_filters_one_hit(spark, sf_dir):
    r = views.reads(spark, sf_dir).where(filters.one_hit(F.col("not_primary"), F.when(F.col("mapq") < 70, F.expr("mapq div 20"))))
    return r.groupBy("contig").agg(F.count("*").alias("n"))


@query("SELECT contig, count(*) AS n FROM v_reads WHERE NOT (first AND st = mate_st AND neg = mate_neg) AND mapq >= 10 GROUP BY contig", ("v_reads",))
def read_filters_paired(spark, sf_dir):
    keep = filters.not_inverted_dup(F.col("first"), F.col("st"), F.col("mate_st"), F.col("neg"), F.col("mate_neg")) & filters.properly_paired(F.col("mapq") >= 10)
    return views.reads(spark, sf_dir).where(keep).groupBy("contig").agg(F.count("*").alias("n"))


@query("SELECT contig AS base, cycle, mapq AS qual, count(*) AS n FROM v_reads GROUP BY 1, 2, 3", ("v_reads",))
def base_quality(spark, sf_dir):
    return reads.base_quality(views.reads(spark, sf_dir).select(F.col("contig").alias("base"), "cycle", F.col("mapq").alias("qual")))


@query(
    f"""{LAID} SELECT base, CAST(o + 1 AS INT) AS cycle, CAST((o * 7 + 3) % 41 AS INT) AS qual, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    ("v_seq",),
)
def base_quality_bases(spark, sf_dir):
    r = views.aligned(spark, sf_dir).withColumn("quals", F.transform(F.sequence(F.lit(0), F.length("bases") - 1), lambda o: (o * 7 + 3) % 41))
    return reads.base_quality(reads.bases_of(r))


READ_LENGTH = """SELECT en - st + 1 + cycle AS length, CASE WHEN cycle > 3 THEN 1 ELSE 0 END AS events, CASE WHEN cycle > 3 THEN cycle ELSE 0 END AS clipped FROM v_reads"""


@query(
    f"""WITH r AS ({READ_LENGTH}) SELECT count(*) AS n, round(avg(length), 6) AS mean_length, round(stddev_samp(length), 6) AS sd_length,
round(avg(events), 6) AS mean_events, round(stddev_samp(events), 6) AS sd_events, round(avg(clipped), 6) AS mean_clipped, round(stddev_samp(clipped), 6) AS sd_clipped,
round(avg(100.0::DOUBLE * clipped / length), 6) AS mean_pct_clipped, round(stddev_samp(100.0::DOUBLE * clipped / length), 6) AS sd_pct_clipped FROM r""",
    ("v_reads",),
)
def read_length(spark, sf_dir):
    r = views.reads(spark, sf_dir)
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    tail = F.when(F.col("cycle") > 3, op("S", F.col("cycle"))).otherwise(op("I", F.col("cycle")))
    return reads.read_length(r.select("name", F.array(op("M", F.col("en") - F.col("st") + 1), tail).alias("cigar")))


@query(
    f"""WITH r AS ({READ_LENGTH.replace(" FROM v_reads", ", (name * 8 + cycle) * 1000 + en - st + 1 + cycle AS id FROM v_reads")}), k AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM r) SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total, CAST(sum(id) AS BIGINT) AS ids FROM k WHERE i % 7 = 0""",
    ("v_reads",),
)
def read_length_skip(spark, sf_dir):
    length = F.col("en") - F.col("st") + 1 + F.col("cycle")
    r = views.reads(spark, sf_dir).select(((F.col("name") * 8 + F.col("cycle")) * 1000 + length).alias("id"), length.alias("length"))
    return reads.every_nth(r, 7, "id").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.sum("id").alias("ids"))


def nmer_sql(last: str) -> str:
    return f"""SELECT nmer, count(*) AS n FROM (SELECT substr(seq, i, {K}) AS nmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - {last})) AS i FROM v_seq)) GROUP BY nmer"""


@query(nmer_sql(f"{K} + 1"), ("v_seq",))
def count_nmer(spark, sf_dir):
    return reads.nmers(views.sequences(spark, sf_dir), K)


@query(nmer_sql(f"{K}"), ("v_seq",))
def count_nmer_parity(spark, sf_dir):
    return reads.nmers(views.sequences(spark, sf_dir), K, parity=True)


# reads with paired ends and mates on other contigs
ENDS = "SELECT *, mapq > 20 AS paired, CASE WHEN mapq > 20 THEN CASE WHEN cycle % 3 = 0 THEN 'N' ELSE contig END END AS mate_contig, CASE WHEN mapq > 20 THEN mate_st END AS mate FROM v_reads WHERE mapq <= 20 OR NOT neg"


def ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).withColumn("paired", F.col("mapq") > 20).withColumn("mate_contig", F.when(F.col("cycle") % 3 == 0, "N").otherwise(F.col("contig")))


@query("SELECT count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_dups FROM (SELECT count(*) AS n FROM v_reads WHERE NOT neg GROUP BY contig, st, mate_st)", ("v_reads",))
def dup_groups(spark, sf_dir):
    return reads.dup_groups(views.reads(spark, sf_dir))


@query(f"SELECT count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_dups FROM (SELECT count(*) AS n FROM ({ENDS}) GROUP BY contig, st, paired, mate_contig, mate)", ("v_reads",))
def dup_groups_mates(spark, sf_dir):
    return reads.dup_groups(ended(spark, sf_dir))


TRIAL = "CAST('0x' || substr(md5('1:' || name || ':' || cycle || ':' || t.t), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
DUPS = """s AS (SELECT t.t AS trial, {key} FROM ({rows}), generate_series(1, {trials}) AS t(t) WHERE {draw} < {p}),
g AS (SELECT trial, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT CAST(trial AS INT) AS trial, CAST(sum(n) AS BIGINT) AS sampled, CAST(sum(n - 1) AS BIGINT) AS dups, round(CAST(sum(n - 1) AS DOUBLE) / sum(n), 6) AS ratio FROM g GROUP BY trial)"""
PLAIN_DUPS = DUPS.format(key="contig, st, mate_st", rows="SELECT * FROM v_reads WHERE NOT neg", trials=TRIALS, draw=TRIAL, p=DUP_P).replace("FROM s GROUP BY ALL", "FROM s GROUP BY trial, contig, st, mate_st")
MATE_DUPS = DUPS.format(key="contig, st, paired, mate_contig, mate", rows=ENDS, trials=TRIALS, draw=TRIAL, p=DUP_P).replace("FROM s GROUP BY ALL", "FROM s GROUP BY trial, contig, st, paired, mate_contig, mate")


@query(f"WITH {PLAIN_DUPS} SELECT * FROM d", ("v_reads",))
def downsample_dups(spark, sf_dir):
    return reads.downsample_dups(views.reads(spark, sf_dir), DUP_P, TRIALS)


@query(f"WITH {MATE_DUPS} SELECT count(*) AS trials, round(avg(sampled), 6) AS sampled, round(avg(dups), 6) AS dups, round(avg(ratio), 5) AS ratio FROM d", ("v_reads",))
def downsample_dups_mean(spark, sf_dir):
    trials = reads.downsample_dups(ended(spark, sf_dir), DUP_P, TRIALS)
    return trials.agg(F.count("*").alias("trials"), F.round(F.avg("sampled"), 6).alias("sampled"), F.round(F.avg("dups"), 6).alias("dups"), F.round(F.avg("ratio"), 5).alias("ratio"))


@query(
    f"""WITH k AS (SELECT count(*) AS m FROM ({ENDS}) GROUP BY contig, st, paired, mate_contig, mate), e AS (SELECT p.p / 10.0::DOUBLE AS p, sum(m * p.p / 10.0::DOUBLE) AS sampled, sum(m * p.p / 10.0::DOUBLE - 1 + (1 - p.p / 10.0::DOUBLE) ** m) AS dups FROM k, generate_series(1, 10) AS p(p) GROUP BY 1)
SELECT p, round(sampled, 4) AS sampled, round(dups, 4) AS dups, round(dups / sampled, 6) AS ratio FROM e""",
    ("v_reads",),
)
def dup_curve(spark, sf_dir):
    return reads.dup_curve(ended(spark, sf_dir), [i / 10 for i in range(1, 11)])


@query("SELECT fid, name FROM (SELECT s_suppkey AS fid, s_name AS name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) WHERE i % 10 = 0")
def every_nth(spark, sf_dir):
    return reads.every_nth(views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), F.col("s_name").alias("name")), 10, "fid")


# ---- bases and contexts ---------------------------------------------------------------


@query(f"SELECT pattern, count(*) AS n FROM (SELECT {cases(*CONTEXTS)} AS pattern FROM v_cyt) GROUP BY pattern", ("v_cyt",))
def iupac_match(spark, sf_dir):
    return methylation.with_pattern(views.cytosines(spark, sf_dir), CONTEXTS).groupBy("pattern").agg(F.count("*").alias("n"))


@query("SELECT id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM v_seq", ("v_seq",))
def reverse_complement(spark, sf_dir):
    return views.sequences(spark, sf_dir).select("id", bases.reverse_complement(F.col("seq")).alias("rc"))


@query(
    """WITH k AS (SELECT contig, pos, c AS ca, t AS cc, opp_tot AS cg, c_nonconv AS ct, CASE q % 5 WHEN 0 THEN 'N' ELSE substr(ctx, 1, 1) END AS ref FROM v_cyt),
b AS (SELECT *, CASE WHEN ref <> 'N' THEN ref WHEN ca >= greatest(cc, cg, ct) THEN 'A' WHEN cc >= greatest(cg, ct) THEN 'C' WHEN cg >= ct THEN 'G' ELSE 'T' END AS base FROM k)
SELECT contig, pos, CASE WHEN ca + cc + cg + ct = 0 OR CAST(CASE base WHEN 'A' THEN ca WHEN 'C' THEN cc WHEN 'G' THEN cg ELSE ct END AS DOUBLE) / (ca + cc + cg + ct) >= 0.5 THEN base ELSE 'N' END AS consensus FROM b""",
    ("v_cyt",),
)
def consensus_context(spark, sf_dir):
    k = views.cytosines(spark, sf_dir).withColumn("ref", F.when(F.col("q") % 5 == 0, "N").otherwise(F.substring("ctx", 1, 1)))
    base = cytosines.consensus_base("ref", {"A": "c", "C": "t", "G": "opp_tot", "T": "c_nonconv"}, least=0.5)
    return k.select("contig", "pos", base.alias("consensus"))


@query(
    """WITH s AS (SELECT 'chr' || (id % 3) AS contig, id, seq, coalesce(sum(length(seq)) OVER (PARTITION BY id % 3 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM v_seq),
ref AS (SELECT contig, base + i AS pos, substr(seq, i, 1) AS ref FROM (SELECT contig, base, seq, unnest(generate_series(1, length(seq))) AS i FROM s)),
r3 AS (SELECT r.*, p.ref AS rp, n.ref AS rn FROM ref r LEFT JOIN ref p ON p.contig = r.contig AND p.pos = r.pos - 1 LEFT JOIN ref n ON n.contig = r.contig AND n.pos = r.pos + 1 WHERE r.ref IN ('C', 'G')),
rd AS (SELECT contig, base + i AS pos, substr(seq, i + 7, 1) AS base, id % 2 = 1 AS neg, id % 5 = 0 AS second
  FROM (SELECT contig, id, base, seq, unnest(generate_series(1, length(seq) - 7)) AS i FROM s WHERE length(seq) > 7)),
j AS (SELECT r.contig, r.pos, r.ref = 'G' AS neg, CASE WHEN r.ref = 'G' THEN translate(reverse(rp || r.ref || rn), 'ACGT', 'TGCA') ELSE rp || r.ref || rn END AS context,
  (r.ref = 'G') = (rd.neg <> rd.second) AS same, CASE WHEN r.ref = 'G' THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS b FROM rd JOIN r3 r ON r.contig = rd.contig AND r.pos = rd.pos),
k AS (SELECT contig, pos, neg, context, count(*) FILTER (same AND b = 'C') AS c, count(*) FILTER (same AND b = 'T') AS t, count(*) FILTER (same AND b IN ('A', 'G')) AS ag,
  count(*) FILTER (NOT same) AS opp_tot, count(*) FILTER (NOT same AND b = 'T') AS opp_a FROM j GROUP BY ALL)
SELECT contig, CAST(pos AS BIGINT) AS pos, neg, context, c, t, ag, opp_tot, opp_a FROM k WHERE c + t >= 1 AND CASE WHEN opp_a + opp_tot = 0 THEN 0 ELSE CAST(opp_a AS DOUBLE) / (opp_a + opp_tot) END <= 0.101""",
    ("v_seq",),
)
def cytosine_pileup_calls(spark, sf_dir):
    s = views.placed(spark, sf_dir)
    ref = s.where("length(seq) > 0").select("contig", F.col("start").alias("chunk_start"), "seq")
    rd = s.where("length(seq) > 7").select("contig", F.col("start").alias("st"), F.col("id").alias("name"), (F.col("id") % 2 == 1).alias("neg"), (F.col("id") % 5 == 0).alias("second"), F.expr("substring(seq, 8)").alias("bases"))
    return cytosines.calls(cytosines.pileup(rd), ref).select("contig", F.col("pos").cast("long").alias("pos"), "neg", "context", "c", "t", "ag", "opp_tot", "opp_a")


@query(
    f"""{LAID}, n AS (SELECT *, lag(base) OVER x AS prev, lead(base) OVER x AS next FROM b WINDOW x AS (PARTITION BY contig, name ORDER BY o))
SELECT contig, base, coalesce(prev, '') AS prev, coalesce(next, '') AS next, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM n WHERE d >= 0 GROUP BY ALL""",
    ("v_seq",),
)
def cigar_pileup(spark, sf_dir):
    piled = alignment.pileup(views.aligned(spark, sf_dir))
    return piled.groupBy("contig", "base", F.coalesce("prev", F.lit("")).alias("prev"), F.coalesce("next", F.lit("")).alias("next")).agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


WALKED = f"""{LAID}, y AS (SELECT *, CASE WHEN neg THEN 46 - o ELSE o + 1 END AS cycle, CASE WHEN neg THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS rb, CASE WHEN neg THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS rr FROM b),
z AS (SELECT *, lag(rb) OVER x AS b0, lead(rb) OVER x AS b1, CASE WHEN abs(lag(d) OVER x - d) = 1 AND d >= 0 AND lag(d) OVER x >= 0 THEN lag(rr) OVER x END AS r0,
CASE WHEN abs(lead(d) OVER x - d) = 1 AND d >= 0 AND lead(d) OVER x >= 0 THEN lead(rr) OVER x END AS r1 FROM y WINDOW x AS (PARTITION BY contig, name ORDER BY cycle)),
t AS (SELECT *, sum(CASE WHEN rb = 'T' THEN 1 ELSE 0 END) OVER (PARTITION BY contig, name ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS converted FROM z WHERE rr = 'C' AND rb IN ('C', 'T') AND cycle BETWEEN 2 AND 45),
x AS (SELECT *, CASE WHEN r0 = b0 OR (r0 = 'C' AND b0 = 'T') THEN r0 ELSE 'N' END || 'C' || CASE WHEN r1 = b1 OR (r1 = 'C' AND b1 = 'T') THEN r1 ELSE 'N' END AS context FROM t)"""


def walked(keep: str) -> str:
    return f"{WALKED} SELECT contig, neg, context, count(*) AS n, count(*) FILTER (rb = 'C') AS c, CAST(sum(pos) AS BIGINT) AS positions, CAST(sum(cycle * converted) AS BIGINT) AS walked FROM x WHERE {keep} GROUP BY ALL"


def walk(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    s = views.placed(spark, sf_dir)
    ref = s.where("length(seq) > 0").select("contig", F.col("start").alias("chunk_start"), "seq")
    calls = alignment.read_cytosines(views.aligned(spark, sf_dir, s), ref, **how)
    return calls.groupBy("contig", "neg", "context").agg(F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("c"), F.sum("pos").alias("positions"), F.sum(F.col("cycle") * F.col("converted")).alias("walked"))


@query(walked("true"), ("v_seq",))
def read_cytosines(spark, sf_dir):
    return walk(spark, sf_dir)


@query(walked("converted >= 2 AND b1 = 'G'"), ("v_seq",))
def read_cytosines_converted_cpg(spark, sf_dir):
    return walk(spark, sf_dir, min_conv=2, cph=False)


@query(
    """SELECT contig, count(*) AS n, CAST(sum(en - st + 1) AS BIGINT) AS bases, CAST(sum(name % 9) AS BIGINT) AS hits FROM v_reads
WHERE mapq >= 20 AND NOT not_primary AND cycle NOT IN (6, 7) AND (contig = 'N' OR cycle % 3 > 0) GROUP BY contig""",
    ("v_reads",),
)
def bam_engine_filters(spark, sf_dir):
    """All reads through a BAM file and back, the filters in its reader."""
    r = views.reads(spark, sf_dir)
    no, text_ = F.lit(False), lambda c: F.col(c).cast("string")
    rows = r.select(
        text_("name").alias("name"), "contig", F.col("st").cast("int").alias("start"), F.col("en").cast("int").alias("end"), "mapq", F.lit(True).alias("paired"), F.lit(True).alias("proper_pair"),
        (F.col("cycle") == 7).alias("unmapped"), no.alias("mate_unmapped"), F.col("neg").alias("neg_strand"), F.col("mate_neg").alias("mate_neg_strand"), F.col("first").alias("first_of_pair"),
        (~F.col("first")).alias("second_of_pair"), "not_primary", (F.col("cycle") == 6).alias("vendor_fail"), no.alias("duplicate"),
        F.array(F.struct(F.lit("M").alias("op"), (F.col("en") - F.col("st") + 1).cast("int").alias("len"))).alias("cigar"), F.when(F.col("cycle") % 3 == 0, "N").otherwise(F.col("contig")).alias("mate_contig"),
        F.col("mate_st").cast("int").alias("mate_start"), F.lit(0).alias("template_len"), F.lit("*").alias("bases"), F.array().cast("array<int>").alias("quals"),
        F.create_map(F.lit("NH"), (F.col("name") % 9).cast("string")).alias("attrs"), F.create_map(F.lit("NH"), F.lit("i")).alias("tag_types"), F.lit(None).cast("string").alias("read_group"),
    )
    path = fresh(spark)
    bam.write(rows, path, [(c, (1 << 31) - 1) for c in ("A", "N", "R")])
    found = bam.read(spark, path, flags={"unmapped": False, "not_primary": False, "vendor_fail": False}, min_mapq=20).where(filters.engine(20, mate=True))
    return found.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"), F.sum(F.col("attrs")["NH"].cast("long")).alias("hits"))


# Counts around cytosines: reads of the cytosine's strand, two bases to either side.  In the
# SQL a read's neighbours are the rows before and after it in the cytosine's direction.
SITES = f"""{LAID}, si AS (SELECT contig, base + i AS pos, substr(seq, i, 1) = 'G' AS cneg, CASE WHEN substr(seq, i, 1) = 'G' THEN translate(substr(seq, i + 1, 1), 'ACGT', 'TGCA') ELSE nullif(substr(seq, i - 1, 1), '') END AS prev_ref,
CASE WHEN substr(seq, i, 1) = 'G' THEN translate(substr(seq, i - 1, 1), 'ACGT', 'TGCA') ELSE substr(seq, i + 1, 1) END AS next_ref FROM (SELECT *, unnest(generate_series(2, length(seq) - 1)) AS i FROM s) WHERE substr(seq, i, 1) IN ('C', 'G')),
la AS (SELECT *, [lag(base, 2) OVER x, lag(base) OVER x, lead(base) OVER x, lead(base, 2) OVER x] AS four FROM b WINDOW x AS (PARTITION BY contig, name ORDER BY o)),
cx AS (SELECT si.contig, si.pos, cneg AS neg, prev_ref, next_ref, CASE WHEN cneg THEN [translate(four[4], 'ACGT', 'TGCA'), translate(four[3], 'ACGT', 'TGCA'), translate(four[2], 'ACGT', 'TGCA'), translate(four[1], 'ACGT', 'TGCA')] ELSE four END AS f
  FROM la JOIN si ON si.contig = la.contig AND si.pos = la.pos AND si.cneg = (la.neg <> la.second)),
cn AS (SELECT contig, pos, neg, prev_ref, next_ref, {', '.join(f"count(*) FILTER (f[{i}] = '{b}') AS {k}_{b.lower()}" for i, k in ((1, 'b2'), (2, 'b1'), (3, 'a1'), (4, 'a2')) for b in 'ACGT')} FROM cx GROUP BY ALL)"""


def agreed(k: str, ref: str | None) -> str:
    common = f"CASE WHEN {k}_a >= greatest({k}_c, {k}_g, {k}_t) THEN 'A' WHEN {k}_c >= greatest({k}_g, {k}_t) THEN 'C' WHEN {k}_g >= {k}_t THEN 'G' ELSE 'T' END"
    base = common if ref is None else f"CASE WHEN coalesce({ref}, 'N') <> 'N' THEN {ref} ELSE {common} END"
    of = f"CASE {base} WHEN 'A' THEN {k}_a WHEN 'C' THEN {k}_c + {k}_t WHEN 'G' THEN {k}_g ELSE {k}_t END"
    return f"CASE WHEN {k}_a + {k}_c + {k}_g + {k}_t = 0 OR CAST({of} AS DOUBLE) / ({k}_a + {k}_c + {k}_g + {k}_t) >= 0.899 THEN {base} ELSE 'N' END"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts two bases to either side of the inner cytosines of the placed sequences."""
    s = views.placed(spark, sf_dir)
    ref = s.where("length(seq) > 0").select("contig", F.col("start").alias("chunk_start"), "seq")
    return contexts.counts_on(views.aligned(spark, sf_dir, s), ref, 2)


@query(f"{SITES} SELECT contig, CAST(pos AS BIGINT) AS pos, neg, {agreed('b2', None)} || {agreed('b1', 'prev_ref')} || 'C' || {agreed('a1', 'next_ref')} || {agreed('a2', None)} AS context FROM cn", ("v_seq",))
def consensus_strings(spark, sf_dir):
    return counted(spark, sf_dir).select("contig", "pos", "neg", contexts.consensus(2, 2, F.col("prev_ref"), F.col("next_ref")).alias("context"))


NEXT = "(a1_a + a1_c + a1_g + a1_t)"


@query(
    f"""{SITES} SELECT contig, neg, count(*) AS n, CAST(sum(a1_a + a1_c + a1_t) AS BIGINT) AS next_h, CAST(sum(b1_c + b1_t) AS BIGINT) AS prev_y, round(avg(CASE WHEN {NEXT} > 0 THEN a1_g / {NEXT} END), 6) AS next_g, round(avg(CASE WHEN b1_a + b1_c + b1_g + b1_t > 0 THEN b1_g / (b1_a + b1_c + b1_g + b1_t) END), 6) AS prev_g
FROM cn WHERE CASE WHEN {NEXT} > 0 THEN a1_g / {NEXT} >= 0.101 ELSE next_ref = 'G' END GROUP BY 1, 2""",
    ("v_seq",),
)
def context_ratios(spark, sf_dir):
    kept = counted(spark, sf_dir).where(contexts.passes_cph(F.col("next_ref"), False))
    sums = [F.sum(contexts.h_count(1)).alias("next_h"), F.sum(contexts.y_count(-1)).alias("prev_y")]
    return kept.groupBy("contig", "neg").agg(F.count("*").alias("n"), *sums, F.round(F.avg(contexts.share(1, "G")), 6).alias("next_g"), F.round(F.avg(contexts.share(-1, "G")), 6).alias("prev_g"))


CALLED = f"""{WALKED}, ca AS (SELECT contig, pos, neg, mode(CASE WHEN context NOT LIKE '%N%' THEN context END) AS context, count(*) FILTER (rb = 'C') AS c FROM x GROUP BY contig, pos, neg),
qu AS (SELECT * FROM ca WHERE c >= 1 AND regexp_matches(context, '^[ACT]C[ACT]$')),
fo AS (SELECT q.*, g.g AS off, CAST(CASE WHEN neg THEN pos - g.g ELSE pos + g.g END AS BIGINT) AS place FROM qu q, generate_series(-5, 4) AS g(g)),
rb AS (SELECT contig, CAST(base + i AS BIGINT) AS place, substr(seq, i, 1) AS base FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM s)),
fl AS (SELECT o.contig, o.pos, o.neg, o.c, o.off, CASE WHEN o.neg THEN translate(r.base, 'ACGT', 'TGCA') ELSE r.base END AS base FROM fo o JOIN rb r ON r.contig = o.contig AND r.place = o.place)"""


def called(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = views.placed(spark, sf_dir)
    ref = s.where("length(seq) > 0").select("contig", F.col("start").alias("chunk_start"), "seq")
    calls = alignment.read_cytosines(views.aligned(spark, sf_dir, s), ref)
    known = F.max(F.when(~F.col("context").contains("N"), F.col("context")))  # one context a position
    return calls.groupBy("contig", "pos", "neg").agg(known.alias("context"), F.sum("c").alias("c")), ref


@query(f"{CALLED} SELECT CAST(off AS INT) AS \"offset\", count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM fl GROUP BY 1", ("v_seq",))
def call_matrix(spark, sf_dir):
    return contexts.call_matrix(*called(spark, sf_dir), up=5, down=4, min_meth=1)


@query(f"{CALLED} SELECT '> ' || contig || '-' || pos || CASE WHEN neg THEN '-' ELSE '+' END || ':' || any_value(c) || 'm' || chr(10) || string_agg(base, '' ORDER BY off) AS value FROM fl GROUP BY contig, pos, neg", ("v_seq",))
def call_fasta(spark, sf_dir):
    return sinks.fasta_lines(contexts.call_sequences(*called(spark, sf_dir), up=5, down=4, min_meth=1)).select("value")


# ---- methylation ----------------------------------------------------------------------

LEVEL = "CASE WHEN c + c_nonconv + t = 0 THEN NULL ELSE CAST(c + c_nonconv AS DOUBLE) / (c + c_nonconv + t) END"
PLAIN = "CASE WHEN c + t = 0 THEN NULL ELSE CAST(c AS DOUBLE) / (c + t) END"
PAT = cases(*CONTEXTS)
PAT2 = cases("HCG", "GCH")


@query(f"SELECT pattern, count(level) AS n, round(avg(level) * 100, 6) AS mean_pct FROM (SELECT {PAT} AS pattern, {LEVEL} AS level FROM v_cyt) WHERE pattern IS NOT NULL GROUP BY pattern", ("v_cyt",))
def meth_level_averages(spark, sf_dir):
    return methylation.averages(views.cytosines(spark, sf_dir), CONTEXTS)


@query(
    f"""WITH m AS (SELECT {PAT} AS pattern, {LEVEL} AS level FROM v_cyt)
SELECT (SELECT count(*) FROM v_reads WHERE NOT not_primary) AS n_reads, """
    + ", ".join(f"round(avg(level) FILTER (pattern = '{p}') * 100, 6) AS pct_{p.lower()}" for p in CONTEXTS)
    + " FROM m",
    ("v_cyt", "v_reads"),
)
def meth_level_coverage(spark, sf_dir):
    return methylation.averages_row(views.cytosines(spark, sf_dir), reads.counter(views.reads(spark, sf_dir).where("NOT not_primary")), CONTEXTS)


PER_READ = f"""WITH p AS (SELECT contig, rd, meth, pos, {PAT2} AS pattern FROM v_cyt),
r AS (SELECT contig, rd, count(*) FILTER (pattern = 'HCG' AND meth) AS num1, count(*) FILTER (pattern = 'HCG') AS den1,
count(*) FILTER (pattern = 'GCH' AND meth) AS num2, count(*) FILTER (pattern = 'GCH') AS den2, list(pos ORDER BY pos) FILTER (pattern IS NOT NULL) AS ats FROM p GROUP BY contig, rd)"""


@query(f"{PER_READ} SELECT num1, den1, num2, den2, count(*) AS n_reads FROM r WHERE den1 > 0 AND den2 > 0 GROUP BY 1, 2, 3, 4", ("v_cyt",))
def fraction_by_context(spark, sf_dir):
    return methylation.fraction_by_context(views.cytosines(spark, sf_dir))


MERGED = f"{PER_READ}, f AS (SELECT round(num1 / den1, 9) AS f1, round(num2 / den2, 9) AS f2, count(*) AS n_reads FROM r WHERE den1 > 0 AND den2 > 0 GROUP BY 1, 2)"


@query(f"{MERGED} SELECT * FROM f", ("v_cyt",))
def fraction_by_context_merged(spark, sf_dir):
    return methylation.fraction_by_context(views.cytosines(spark, sf_dir), merge=True)


@query(f"{MERGED} SELECT a.f1, b.f2, coalesce(f.n_reads, 0) AS n_reads FROM (SELECT DISTINCT f1 FROM f) a CROSS JOIN (SELECT DISTINCT f2 FROM f) b LEFT JOIN f ON f.f1 = a.f1 AND f.f2 = b.f2", ("v_cyt",))
def fraction_by_context_dense(spark, sf_dir):
    return methylation.fraction_by_context(views.cytosines(spark, sf_dir), merge=True, dense=True)


@query(f"SELECT contig, rd, pattern, count(*) FILTER (meth) AS num, count(*) AS den FROM (SELECT contig, rd, meth, {PAT} AS pattern FROM v_cyt) WHERE pattern IS NOT NULL GROUP BY ALL", ("v_cyt",))
def read_meth_levels(spark, sf_dir):
    return methylation.read_levels(views.cytosines(spark, sf_dir), CONTEXTS)


@query(
    f"""{PER_READ}, l AS (SELECT CASE WHEN num1 / den1 <= 0.1 THEN 'low' WHEN num1 / den1 > 0.9 THEN 'high' END AS a_level,
CASE WHEN num2 / den2 <= 0.1 THEN 'low' WHEN num2 / den2 > 0.9 THEN 'high' END AS b_level FROM r WHERE den1 > 0 AND den2 > 0)
SELECT a_level, b_level, count(*) AS n_reads FROM l WHERE a_level IS NOT NULL AND b_level IS NOT NULL GROUP BY 1, 2""",
    ("v_cyt",),
)
def read_quadrants(spark, sf_dir):
    return methylation.quadrants(views.cytosines(spark, sf_dir))


@query(
    f"""{PER_READ} SELECT contig, rd, ats[1 + CAST(least(floor(len(ats) / 2 + 0.5), len(ats) - 1) AS INT)] AS pos FROM r
WHERE den1 >= 1 AND den2 >= 1 AND num1 / den1 BETWEEN 0.4 AND 1 AND num2 / den2 BETWEEN 0 AND 0.6""",
    ("v_cyt",),
)
def frac_meth_finder(spark, sf_dir):
    return methylation.find_reads(views.cytosines(spark, sf_dir), range1=(0.4, 1.0), range2=(0.0, 0.6))


HIDDEN = cases("HCH", "GCG")


@query(f"SELECT contig, pos, ctx, CASE WHEN neg THEN -1 ELSE 1 END AS strand, CAST(floor(100 * level + 0.5) AS INT) AS value, c + t AS n_reads FROM (SELECT *, {PLAIN} AS level, {HIDDEN} AS hid FROM v_cyt) WHERE hid IS NULL AND level IS NOT NULL", ("v_cyt",))
def context_track(spark, sf_dir):
    return methylation.context_track(views.cytosines(spark, sf_dir))


@query(f"SELECT contig, pos, ctx, CASE WHEN neg THEN -1 ELSE 1 END AS strand, c + t AS value, c + t AS n_reads FROM (SELECT *, {PLAIN} AS level FROM v_cyt) WHERE level IS NOT NULL", ("v_cyt",))
def context_track_coverage(spark, sf_dir):
    return methylation.context_track(views.cytosines(spark, sf_dir), keep_all=True, coverage=True)


OPP = "CASE WHEN opp_a + opp_tot = 0 THEN 0 ELSE CAST(opp_a AS DOUBLE) / (opp_a + opp_tot) END"


@query(
    f"""SELECT contig, pos, CASE WHEN neg THEN '-' ELSE '+' END AS strand, c + c_nonconv + t + ag AS total, c, c_nonconv, t, ag, opp_tot, opp_a, ctx, round(level * 100, 6) AS pct_meth
FROM (SELECT *, {LEVEL} AS level FROM v_cyt) WHERE NOT ({OPP} >= 0.2 AND opp_a >= 2) AND (substr(ctx, 3, 1) = 'G' OR (c + c_nonconv + t + ag >= 5 AND coalesce(level, 0) >= 0.25))""",
    ("v_cyt",),
)
def methyl_db_rows(spark, sf_dir):
    return methylation.db_rows(views.cytosines(spark, sf_dir), 5, 0.25)


W5 = "CASE WHEN lag(pos) OVER o IS NULL THEN NULL WHEN pos - lag(pos) OVER o = 1 AND neg AND NOT lag(neg) OVER o THEN lag(pos) OVER o - lag(pos, 2) OVER o ELSE pos - lag(pos) OVER o END"
WEIGHTED = f"WITH w AS (SELECT *, {W5} AS weight, {PLAIN} AS level FROM v_cyt WINDOW o AS (PARTITION BY contig ORDER BY pos))"


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methylation.weights(views.cytosines(spark, sf_dir)).withColumn("level", bases.meth(F.col("c"), F.col("t")))


@query(f"{WEIGHTED} SELECT contig, pos, weight FROM w", ("v_cyt",))
def cpg_weights(spark, sf_dir):
    return weighted(spark, sf_dir).select("contig", "pos", "weight")


def summary_sql(keys: str) -> str:
    return f"""{WEIGHTED}, u AS (SELECT *, CAST(CASE WHEN weight < 0 OR weight > 5000 THEN 100 ELSE weight END AS DOUBLE) / 2 AS cw FROM w)
SELECT {keys}, count(level) AS n, round(avg(level), 6) AS mean, round(sum(cw * level) FILTER (cw > 0 AND level IS NOT NULL) / sum(cw) FILTER (cw > 0 AND level IS NOT NULL), 6) AS weighted_mean,
round(stddev_pop(level), 6) AS sd, round(min(level), 6) AS low, round(max(level), 6) AS high FROM u GROUP BY {keys}"""


@query(summary_sql("ctx"), ("v_cyt",))
def cpg_summarizer(spark, sf_dir):
    return methylation.summarise(weighted(spark, sf_dir), ["ctx"], F.col("level"), methylation.clamp_weight(F.col("weight")))


@query(summary_sql("ctx, neg"), ("v_cyt",))
def cpg_summarizer_stranded(spark, sf_dir):
    return methylation.summarise(weighted(spark, sf_dir), ["ctx", "neg"], F.col("level"), methylation.clamp_weight(F.col("weight")))


@query("SELECT contig % 7 AS part, ctx, CAST(sum(c) AS BIGINT) AS c, CAST(sum(c_nonconv) AS BIGINT) AS c_nonconv, CAST(sum(t) AS BIGINT) AS t, CAST(sum(ag) AS BIGINT) AS ag, CAST(sum(opp_tot) AS BIGINT) AS opp_tot, CAST(sum(opp_a) AS BIGINT) AS opp_a FROM v_cyt GROUP BY 1, 2", ("v_cyt",))
def composite_cytosines(spark, sf_dir):
    return methylation.composite(views.cytosines(spark, sf_dir).withColumn("part", F.col("contig") % 7), ["part", "ctx"])


def drawn(n: str, p: str, name: str) -> str:
    """Binomial inversion of at most 16 trials, spelt out."""
    u = f"(CAST('0x' || substr(md5('1:' || contig || ':' || pos || ':{name}:1'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    q = f"least({p}, 1 - {p})"
    cdf = f"list_sum(list_transform(generate_series(0, j), lambda i: factorial(CAST({n} AS INT)) / (factorial(CAST(i AS INT)) * factorial(CAST({n} - i AS INT)))::DOUBLE * {q} ** i * (1 - {q}) ** ({n} - i)))"
    k = f"len(list_filter(generate_series(0, {n} - 1), lambda j: {cdf} <= {u}))"
    return f"CAST(CASE WHEN {n} < 1 OR {p} <= 0 THEN 0 WHEN {p} >= 1 THEN {n} WHEN {p} > 0.5 THEN {n} - {k} ELSE {k} END AS BIGINT)"


@query(
    f"""WITH a AS (SELECT *, {drawn("c", "0.4::DOUBLE", "c")} AS c1, {drawn("c_nonconv", "0.4::DOUBLE", "c_nonconv")} AS n1, {drawn("t", "0.4::DOUBLE", "t")} AS t1, {drawn("ag", "0.4::DOUBLE", "ag")} AS ag1,
{drawn("opp_tot", "0.4::DOUBLE", "opp_tot")} AS ot1, CASE WHEN opp_tot = 0 THEN 0.0 ELSE CAST(opp_a AS DOUBLE) / opp_tot END AS share FROM v_cyt)
SELECT contig, pos, c1 AS c, n1 AS c_nonconv, t1 AS t, ag1 AS ag, ot1 AS opp_tot, {drawn("ot1", "share", "opp_a")} AS opp_a FROM a""",
    ("v_cyt",),
)
def thinned_cytosines(spark, sf_dir):
    return methylation.thinned(views.cytosines(spark, sf_dir), 0.4).select("contig", "pos", "c", "c_nonconv", "t", "ag", "opp_tot", "opp_a")


TWO = "CASE WHEN {0} IS NULL THEN 'NaN' ELSE printf('%.2f', CAST({0} AS DOUBLE)) END"


@query(
    f"""{WEIGHTED}, n AS (SELECT *, q % 3 AS next_g, q % 3 + q % 4 AS next_total FROM w)
SELECT contig, concat_ws(chr(9), pos, CASE WHEN neg THEN '-' ELSE '+' END, c + c_nonconv + t + ag, c, c_nonconv, t, ag, opp_tot, opp_a, next_g, next_total, substr(ctx, 3, 1), substr(ctx, 1, 1),
{TWO.format('100 * level')}, {TWO.format('CASE WHEN next_total > 0 THEN 100.0 * next_g / next_total END')}, {TWO.format('weight')}) AS value FROM n""",
    ("v_cyt",),
)
def methyl_db_lines(spark, sf_dir):
    c = methylation.weights(views.cytosines(spark, sf_dir)).withColumns({"next_g": F.col("q") % 3, "next_total": F.col("q") % 3 + F.col("q") % 4, "next_ref": F.substring("ctx", 3, 1), "prev_ref": F.substring("ctx", 1, 1)})
    return methylation.db_lines(c).select("contig", "value")


@query(
    f"""{WALKED} SELECT contig, concat_ws(chr(9), CAST(pos AS BIGINT), CASE WHEN neg THEN '-' ELSE '+' END, name, CASE WHEN rb = 'C' THEN 1 ELSE 0 END, 0, CASE WHEN rb = 'T' THEN 1 ELSE 0 END, 0, 0, 0,
context LIKE 'G__', substr(context, 1, 1), context LIKE '__G', substr(context, 3, 1), 'NaN') AS value FROM x""",
    ("v_seq",),
)
def methyl_read_lines(spark, sf_dir):
    s = views.placed(spark, sf_dir)
    ref = s.where("length(seq) > 0").select("contig", F.col("start").alias("chunk_start"), "seq")
    return methylation.read_lines(alignment.read_cytosines(views.aligned(spark, sf_dir, s), ref)).select("contig", "value")


@query(
    """WITH w AS (SELECT 'chr' || (id % 3) AS contig, string_agg(seq, '' ORDER BY id) AS seq FROM v_seq GROUP BY 1), i AS (SELECT fid, 'chr' || (fid % 3) AS contig, fs * 7 AS st, fs * 7 + 30 AS en FROM v_features)
SELECT fid, i.contig, st, en, substr(seq, CAST(st AS INT), 31) AS seq FROM i JOIN w ON w.contig = i.contig WHERE en <= length(seq)""",
    ("v_seq", "v_features"),
)
def reference_fetch(spark, sf_dir):
    s = views.placed(spark, sf_dir)
    ref = s.where("length(seq) > 0").select("contig", F.col("start").alias("chunk_start"), "seq")
    f = views.features(spark, sf_dir).select("fid", F.concat(F.lit("chr"), F.col("fid") % 3).alias("contig"), (F.col("fs") * 7).alias("st"), (F.col("fs") * 7 + 30).alias("en"))
    return contexts.fetch(f, ref)


# ---- windows --------------------------------------------------------------------------

USE = "level IS NOT NULL AND weight > 0"


@query(
    f"""{WEIGHTED}, e AS (SELECT a.contig, a.pos, (SELECT max(b.pos) FROM w b WHERE b.contig = a.contig AND b.pos <= a.pos - {FIXED_W}) AS start FROM w a)
SELECT e.contig, e.start, e.pos AS "end", count(*) AS n, round(sum(b.level * b.weight) FILTER (b.level IS NOT NULL AND b.weight > 0) / sum(b.weight) FILTER (b.level IS NOT NULL AND b.weight > 0), 6) AS mean
FROM e JOIN w b ON b.contig = e.contig AND b.pos >= e.start AND b.pos <= e.pos AND (b.pos = e.start OR b.pos > e.pos - {FIXED_W}) WHERE e.start IS NOT NULL GROUP BY e.contig, e.start, e.pos HAVING count(*) >= {FIXED_N}""",
    ("v_cyt",),
)
def window_fixed(spark, sf_dir):
    return windows.fixed(weighted(spark, sf_dir), FIXED_W, FIXED_N)


def variable_sql(back: int) -> str:
    return f"""{WEIGHTED}, v AS (SELECT contig, lag(pos, {VAR_K - 1}) OVER o AS start, lag(pos, {VAR_K}) OVER o AS before, pos AS "end",
round(sum(CASE WHEN {USE} THEN level * weight END) OVER r / sum(CASE WHEN {USE} THEN weight END) OVER r, 6) AS mean
FROM w WINDOW o AS (PARTITION BY contig ORDER BY pos), r AS (PARTITION BY contig ORDER BY pos ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)),
vw AS (SELECT contig, start, "end", mean FROM v WHERE "end" - before < {VAR_STRETCH})"""


@query(f"{variable_sql(VAR_K - 1)} SELECT * FROM vw", ("v_cyt",))
def window_variable(spark, sf_dir):
    return windows.variable(weighted(spark, sf_dir), VAR_K, VAR_STRETCH)


@query(f"{variable_sql(VAR_K)} SELECT * FROM vw", ("v_cyt",))
def window_variable_parity(spark, sf_dir):
    return windows.variable(weighted(spark, sf_dir), VAR_K, VAR_STRETCH, parity=True)


@query(
    f"""{variable_sql(VAR_K - 1)}, b AS (SELECT contig, lag(CAST(floor((start + "end") / 2 + 0.5) AS BIGINT)) OVER o AS span_start, CAST(floor((start + "end") / 2 + 0.5) AS BIGINT) AS span_end,
lag(mean) OVER o AS value FROM vw WINDOW o AS (PARTITION BY contig ORDER BY "end")) SELECT * FROM b WHERE span_start IS NOT NULL""",
    ("v_cyt",),
)
def window_bedgraph(spark, sf_dir):
    return windows.bedgraph(windows.variable(weighted(spark, sf_dir), VAR_K, VAR_STRETCH))


CONDITIONS = {"HCG": "ctx IN ('ACG', 'TCG')", "GCH": "ctx IN ('GCA', 'GCT')"}


def condition_sql(by: str) -> str:
    """Windows of each condition: cytosines of the condition, or all for each."""
    return f"""{WEIGHTED}, cw AS (SELECT k.cond AS condition, w.* FROM w, (SELECT unnest(['HCG', 'GCH']) AS cond) k WHERE {by}),
v AS (SELECT condition, contig, lag(pos, {VAR_K - 1}) OVER o AS start, lag(pos, {VAR_K}) OVER o AS before, pos AS "end", round(sum(CASE WHEN {USE} THEN level * weight END) OVER r / sum(CASE WHEN {USE} THEN weight END) OVER r, 6) AS mean
FROM cw WINDOW o AS (PARTITION BY condition, contig ORDER BY pos), r AS (PARTITION BY condition, contig ORDER BY pos ROWS BETWEEN {VAR_K - 1} PRECEDING AND CURRENT ROW))
SELECT condition, contig, start, "end", mean FROM v WHERE "end" - before < 3 * {VAR_STRETCH}"""


@query(condition_sql("(cond = 'HCG' AND ctx IN ('ACG', 'TCG')) OR (cond = 'GCH' AND ctx IN ('GCA', 'GCT'))"), ("v_cyt",))
def window_by_condition(spark, sf_dir):
    return windows.by_condition(weighted(spark, sf_dir), {k: F.expr(v) for k, v in CONDITIONS.items()}, VAR_K, 3 * VAR_STRETCH)


@query(condition_sql("true"), ("v_cyt",))
def window_by_condition_parity(spark, sf_dir):
    return windows.by_condition(weighted(spark, sf_dir), {k: F.expr(v) for k, v in CONDITIONS.items()}, VAR_K, 3 * VAR_STRETCH, parity=True)


# ---- pairs ----------------------------------------------------------------------------

SIX = "count(*) FILTER (a) AS n_m, count(*) FILTER (NOT a) AS n_u, count(*) FILTER (a AND b) AS n_mm, count(*) FILTER (a AND NOT b) AS n_mu, count(*) FILTER (NOT a AND b) AS n_um, count(*) FILTER (NOT a AND NOT b) AS n_uu"


@query(f"SELECT dist, {SIX} FROM (SELECT y.pos - x.pos - 1 AS dist, x.meth AS a, y.meth AS b FROM v_cr x JOIN v_cr y ON x.contig = y.contig AND x.rd = y.rd AND y.pos > x.pos AND y.pos - x.pos < {PAIR_W}) GROUP BY dist", ("v_cr",))
def pairs_autocorr_same_read(spark, sf_dir):
    return pairs.same_read(views.cytosine_reads(spark, sf_dir), PAIR_W)


def any_sql(keep: str) -> str:
    return f"""WITH m AS MATERIALIZED (SELECT * FROM v_cr),
low AS MATERIALIZED (SELECT contig, pos, rd, meth, row_number() OVER o AS k, first_value(rd) OVER o AS fr FROM m WINDOW o AS (PARTITION BY contig, pos ORDER BY rd) QUALIFY k <= 2),
p AS (SELECT x.pos AS ap, x.rd AS ar, y.pos AS bp, y.rd AS br, x.meth AS a, y.meth AS b, k, fr FROM m x JOIN low y ON x.contig = y.contig AND y.pos > x.pos AND y.pos - x.pos < {PAIR_W})
SELECT bp - ap - 1 AS dist, {SIX} FROM p WHERE {keep} GROUP BY 1"""


@query(any_sql("k = 1 OR (k = 2 AND fr = ar)"), ("v_cr",))
def pairs_autocorr(spark, sf_dir):
    return pairs.any_read(views.cytosine_reads(spark, sf_dir), PAIR_W)


@query(any_sql("(k = 1 AND br <> ar) OR (k = 2 AND fr = ar)"), ("v_cr",))
def pairs_autocorr_different_read(spark, sf_dir):
    return pairs.any_read(views.cytosine_reads(spark, sf_dir), PAIR_W, only_different=True)


@query(f"SELECT dist, {SIX} FROM (SELECT abs(y.pos - x.pos) - 1 AS dist, x.meth AS a, y.meth AS b FROM v_cr x JOIN v_cr y ON x.contig = y.contig AND x.rd = y.rd AND y.pos <> x.pos AND abs(y.pos - x.pos) < {PAIR_W} AND x.ctx = 'WCG' AND y.ctx = 'GCH') GROUP BY dist", ("v_cr",))
def pairs_autocorr_by_context(spark, sf_dir):
    return pairs.by_context(views.cytosine_reads(spark, sf_dir), PAIR_W, "WCG", "GCH")


@query(
    f"""WITH f AS (SELECT c.contig, c.pos, c.rd, c.meth, min(fs) AS fs, max(fe) AS fe FROM v_cr c LEFT JOIN v_features ON c.pos BETWEEN fs AND fe GROUP BY ALL)
SELECT dist, {SIX} FROM (SELECT CASE WHEN x.fs IS NULL THEN y.fs - x.pos ELSE y.pos - x.fe END AS dist, x.meth AS a, y.meth AS b
FROM f x JOIN f y ON x.contig = y.contig AND x.rd = y.rd AND y.pos > x.pos AND y.pos - x.pos < {PAIR_W} AND (x.fs IS NULL) <> (y.fs IS NULL)) GROUP BY dist""",
    ("v_cr", "v_features"),
)
def pairs_across_boundary(spark, sf_dir):
    return pairs.across_boundary(views.cytosine_reads(spark, sf_dir), views.features(spark, sf_dir), PAIR_W)


STRANDED = "SELECT *, pos % 5 < 2 AS neg FROM v_cr WHERE ctx IN ('WCG', 'GCH')"


@query(
    f"""WITH s AS ({STRANDED}), p AS (SELECT abs(y.pos - x.pos) - 1 AS dist, x.rd = y.rd AS same, x.neg = y.neg AS strand, x.meth AS first, y.meth AS second FROM s x JOIN s y ON x.contig = y.contig AND x.ctx = 'WCG' AND y.ctx = 'GCH' AND y.pos <> x.pos AND abs(y.pos - x.pos) < {CUBE_W}),
e AS (SELECT CASE WHEN same THEN 'same' ELSE 'different' END AS reads, unnest(['any', CASE WHEN strand THEN 'same' ELSE 'opposite' END]) AS strands, first, second, dist FROM p)
SELECT reads, strands, first, second, dist, count(*) AS n FROM e GROUP BY ALL""",
    ("v_cr",),
)
def pairs_condition_cube(spark, sf_dir):
    return pairs.condition_cube(views.cytosine_reads(spark, sf_dir).withColumn("neg", F.col("pos") % 5 < 2), CUBE_W)


@query(
    f"""WITH s AS ({STRANDED}) SELECT x.neg AS a_neg, (x.pos + y.pos + 1) // 2 // 50 AS region, count(*) AS n, count(*) FILTER (x.meth = y.meth) AS agree
FROM s x JOIN s y ON x.contig = y.contig AND x.rd = y.rd AND y.pos > x.pos AND y.pos - x.pos < {PAIR_W} AND x.neg <> y.neg GROUP BY 1, 2""",
    ("v_cr",),
)
def pairs_opposite_strand(spark, sf_dir):
    cr = views.cytosine_reads(spark, sf_dir).where("ctx IN ('WCG', 'GCH')").withColumn("neg", F.col("pos") % 5 < 2)
    p = pairs.near_pairs(cr, cr, PAIR_W, ["contig", "rd"], pairs.same_strand(False))
    return p.groupBy("a_neg", F.floor(pairs.midpoint() / 50).alias("region")).agg(F.count("*").alias("n"), F.count_if(F.col("a_meth") == F.col("b_meth")).alias("agree"))


# ---- features -------------------------------------------------------------------------

OFFSET = "floor(CAST(CASE WHEN strand = '-' THEN fe - pos ELSE pos - fs END AS DOUBLE) / " + str(FEATURE_BIN) + ")"


@query(f"SELECT fid, CAST({OFFSET} AS INT) AS bin, count(v) AS n, round(avg(v), 6) AS mean FROM (SELECT *, {PLAIN} AS v FROM v_cyt) c JOIN v_features f ON f.strand <> '.' AND c.pos BETWEEN fs - {FLANK} AND fe + {FLANK} GROUP BY 1, 2", ("v_cyt", "v_features"))
def feature_alignment(spark, sf_dir):
    return features.profile(views.cytosines(spark, sf_dir), views.features(spark, sf_dir), FLANK, FEATURE_BIN, bases.meth(F.col("c"), F.col("t")))


READ_POINTS = f"""WITH pt AS (SELECT contig, rd, pattern, CAST(floor((min(pos) + max(pos)) / 2) AS BIGINT) AS pos, CAST(count(*) FILTER (meth) AS DOUBLE) / count(*) AS v
FROM (SELECT contig, rd, pos, meth, {PAT2} AS pattern FROM v_cyt) WHERE pattern IS NOT NULL GROUP BY contig, rd, pattern)"""


@query(f"{READ_POINTS} SELECT pattern, fid, CAST({OFFSET} AS INT) AS bin, count(v) AS n, round(avg(v), 6) AS mean FROM pt JOIN v_features f ON f.strand <> '.' AND pt.pos BETWEEN fs - {FLANK} AND fe + {FLANK} GROUP BY 1, 2, 3", ("v_cyt", "v_features"))
def feature_alignment_reads(spark, sf_dir):
    c = methylation.with_pattern(views.cytosines(spark, sf_dir), ["HCG", "GCH"]).where("pattern IS NOT NULL")
    mid = F.floor((F.min("pos") + F.max("pos")) / 2).cast("long")
    points = c.groupBy("contig", "rd", "pattern").agg(mid.alias("pos"), (F.count_if("meth") / F.count("*")).alias("v"))
    return features.profile(points, views.features(spark, sf_dir), FLANK, FEATURE_BIN, F.col("v"), ["pattern"])


ANCHOR = "CASE WHEN strand = '-' THEN fe ELSE fs END"
COLUMNS = 10


@query(
    f"""WITH f AS (SELECT fid, strand, {ANCHOR} AS anchor FROM v_features WHERE strand <> '.'), o AS (SELECT fid, neg, {PLAIN} AS v, CASE WHEN strand = '-' THEN anchor - pos ELSE pos - anchor END + {FLANK} AS col FROM v_cyt JOIN f ON pos BETWEEN anchor - {FLANK} AND anchor + {FLANK})
SELECT neg, fid, CAST(p.p AS INT) AS cell, count(v) AS n, round(avg(v), 6) AS mean FROM o, generate_series(0, {COLUMNS - 1}) AS p(p) WHERE col BETWEEN p.p * {2 * FLANK // COLUMNS} AND (p.p + 1) * {2 * FLANK // COLUMNS} GROUP BY 1, 2, 3""",
    ("v_cyt", "v_features"),
)
def feature_alignment_columns(spark, sf_dir):
    return features.profile_columns(views.cytosines(spark, sf_dir), views.features(spark, sf_dir), FLANK, COLUMNS, bases.meth(F.col("c"), F.col("t")), ["neg"])


ENOUGH = f"""WITH pt AS (SELECT contig, rd, {PAT2} AS pattern, pos, meth FROM v_cyt), pn AS (SELECT contig, rd, pattern, CAST(floor((min(pos) + max(pos)) / 2) AS BIGINT) AS pos, CAST(count(*) FILTER (meth) AS DOUBLE) / count(*) AS v, count(*) AS n FROM pt WHERE pattern IS NOT NULL GROUP BY 1, 2, 3),
pe AS (SELECT * FROM pn WHERE n >= CASE pattern WHEN 'HCG' THEN 2 ELSE 1 END), en AS (SELECT * FROM pe WHERE (SELECT count(*) FROM pe q WHERE q.contig = pe.contig AND q.rd = pe.rd) = 2)"""
NEAR = f"JOIN v_features f ON f.strand <> '.' AND pos BETWEEN fs - {FLANK} AND fe + {FLANK}"


@query(f"{ENOUGH} SELECT pattern, fid, CAST({OFFSET} AS INT) AS bin, count(v) AS n, round(avg(v), 6) AS mean FROM en {NEAR} GROUP BY 1, 2, 3", ("v_cyt", "v_features"))
def feature_alignment_enough(spark, sf_dir):
    points = methylation.read_points(views.cytosines(spark, sf_dir), {"HCG": 2, "GCH": 1})
    return features.profile(points, views.features(spark, sf_dir), FLANK, FEATURE_BIN, F.col("v"), ["pattern"])


@query(
    f"""{ENOUGH}, qa AS (SELECT a.contig, a.rd, a.pos, CASE WHEN a.v <= 0.1 THEN 'low' WHEN a.v > 0.9 THEN 'high' END || '_' || CASE WHEN b.v <= 0.1 THEN 'low' WHEN b.v > 0.9 THEN 'high' END AS quadrant, 1.0::DOUBLE AS v
  FROM en a JOIN en b ON a.contig = b.contig AND a.rd = b.rd AND a.pattern = 'HCG' AND b.pattern = 'GCH')
SELECT quadrant, fid, CAST({OFFSET} AS INT) AS bin, count(v) AS n, round(avg(v), 6) AS mean FROM qa {NEAR} AND quadrant IS NOT NULL GROUP BY 1, 2, 3""",
    ("v_cyt", "v_features"),
)
def feature_alignment_quadrants(spark, sf_dir):
    points = methylation.quadrant_points(methylation.read_points(views.cytosines(spark, sf_dir), {"HCG": 2, "GCH": 1}), "HCG", "GCH")
    return features.profile(points, views.features(spark, sf_dir), FLANK, FEATURE_BIN, F.col("v"), ["quadrant"])


def nearest_sql(end: str) -> str:
    return f"""WITH f AS (SELECT fid, grp, fs, {end} AS fe FROM v_features), d AS (SELECT c.pos AS pid, c.pos % 3 AS grp, c.pos, f.fid, f.fe, greatest(0, fs - c.pos, c.pos - f.fe) AS distance FROM v_cyt c JOIN f ON f.grp = c.pos % 3)
SELECT pid, grp, pos, CAST(fid AS BIGINT) AS fid, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, CASE WHEN distance = 0 THEN -fe END, fid) AS k FROM d) WHERE k = 1"""


def nearest(spark: SparkSession, sf_dir: str, end: str) -> DataFrame:
    points = views.cytosines(spark, sf_dir).select(F.col("pos").alias("pid"), (F.col("pos") % 3).alias("grp"), "pos")
    return features.nearest(points, views.features(spark, sf_dir).withColumn("fe", F.expr(end)), "grp")


@query(nearest_sql("fe"), ("v_cyt", "v_features"))
def nearest_feature(spark, sf_dir):
    return nearest(spark, sf_dir, "fe")


@query(nearest_sql("fs + fid * 37 % 900"), ("v_cyt", "v_features"))
def nearest_feature_nested(spark, sf_dir):
    return nearest(spark, sf_dir, "fs + fid * 37 % 900")


@query(
    f"""WITH h AS (SELECT seq, i FROM (SELECT seq, unnest(generate_series(1, length(seq) - {len(MOTIF) - 1})) AS i FROM v_seq) WHERE substr(seq, i, {len(MOTIF)}) = '{MOTIF}'),
o AS (SELECT o.o AS "offset", substr(seq, i + o.o, 1) AS base FROM h, generate_series({-MOTIF_FLANK}, {MOTIF_FLANK}) AS o(o) WHERE i + o.o BETWEEN 1 AND length(seq))
SELECT CAST("offset" AS INT) AS "offset", count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM o GROUP BY 1""",
    ("v_seq",),
)
def sequence_matrix(spark, sf_dir):
    return features.sequence_matrix(views.sequences(spark, sf_dir), MOTIF, MOTIF_FLANK)


@query(
    """WITH r AS (SELECT DISTINCT contig, st, en FROM v_reads), o AS (SELECT *, max(en) OVER (PARTITION BY contig ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR st > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS i FROM o)
SELECT contig, min(st) AS st, max(en) AS en FROM g GROUP BY contig, i""",
    ("v_reads",),
)
def merge_intervals(spark, sf_dir):
    return features.merge_intervals(views.reads(spark, sf_dir).select("contig", "st", "en").distinct())


@query("SELECT r.contig, count(*) AS n FROM v_reads r WHERE EXISTS (SELECT 1 FROM v_features f WHERE f.strand = '+' AND r.st <= f.fe AND r.en >= f.fs) GROUP BY r.contig", ("v_reads", "v_features"))
def interval_restriction(spark, sf_dir):
    r = views.reads(spark, sf_dir)
    regions = views.features(spark, sf_dir).where("strand = '+'").select(F.col("fs").alias("st"), F.col("fe").alias("en")).crossJoin(r.select("contig").distinct())
    return features.intervals(r, regions).groupBy("contig").agg(F.count("*").alias("n"))


# ---- matrices -------------------------------------------------------------------------

CELLS = 'WITH m AS (SELECT vec_id AS "row", i - 1 AS col, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))'
STATS = "round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(sum(v), 6) AS total"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.long_form(views.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f'{CELLS} SELECT "row", {STATS} FROM m GROUP BY "row"')
def matrix_row_means(spark, sf_dir):
    return matrix.row_stats(cells(spark, sf_dir))


@query(f"{CELLS} SELECT CAST(col AS INT) AS col, {STATS} FROM m GROUP BY col")
def matrix_col_means(spark, sf_dir):
    return matrix.row_stats(cells(spark, sf_dir), "col")


@query(f'{CELLS} SELECT "row", CAST(p.p AS INT) AS cell, round(avg(v), 6) AS v FROM m, generate_series(0, 9) AS p(p) WHERE col BETWEEN p.p * 6 AND (p.p + 1) * 6 GROUP BY 1, 2')
def matrix_downscale(spark, sf_dir):
    return matrix.downscale(cells(spark, sf_dir), 64, 10)


@query(f'{CELLS} SELECT "row", CAST(col AS INT) AS col, round(v / sum(v) OVER (PARTITION BY "row"), 6) AS v FROM (SELECT "row", col, abs(v) + 0.5 AS v FROM m)')
def matrix_normalise(spark, sf_dir):
    return matrix.normalise(cells(spark, sf_dir).withColumn("v", F.abs("v") + 0.5))


@query(f"{CELLS}, b AS (SELECT CAST(greatest(0, least(9, ceil((v + 0.5) / 0.1) - 1)) AS INT) AS bin FROM m) SELECT bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY bin")
def histogram_bins(spark, sf_dir):
    return matrix.histogram_bins(cells(spark, sf_dir), F.col("v"), -0.5, 0.5, 10)


@query(f'{CELLS}, r AS (SELECT "row", avg(v) AS mean FROM m GROUP BY "row") SELECT "row", row_number() OVER (ORDER BY coalesce(mean, -1e-5), "row") AS rank FROM r')
def sort_rows_by_mean(spark, sf_dir):
    return matrix.sort_rows(cells(spark, sf_dir))


@query(f"{CELLS}, r AS (SELECT \"row\", round(sum(v * (greatest(abs(col - 31.5::DOUBLE), 2.0::DOUBLE) ** -1.0) / (2.0::DOUBLE ** -1.0)) / count(v), 6) AS mean FROM m GROUP BY \"row\") SELECT \"row\", row_number() OVER (ORDER BY coalesce(mean, -1e-5), \"row\") AS rank FROM r")
def sort_rows_by_weighted_mean(spark, sf_dir):
    m = cells(spark, sf_dir)
    return matrix.sort_rows(m, matrix.exp_weighted_mean(m, 64, 2.0, -1.0))


# cells between -0.05 and 0.05 are missing
HOLES = CELLS + ", x AS (SELECT \"row\", col, CASE WHEN abs(v) >= 0.05 THEN v END AS v FROM m)"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("v", F.when(F.abs("v") >= 0.05, F.col("v")))


@query(f'{HOLES} SELECT "row", min(v) AS low, max(v) AS high, round(var_pop(v), 6) AS variance, count(*) FILTER (v IS NULL) AS missing FROM x GROUP BY "row"')
def matrix_spread(spark, sf_dir):
    return matrix.spread(holes(spark, sf_dir))


@query(f"{HOLES} SELECT round(sum(v), 4) AS total FROM x")
def matrix_sum_all(spark, sf_dir):
    return matrix.sum_all(holes(spark, sf_dir))


@query(f'{HOLES} SELECT CAST(col AS INT) AS "row", "row" AS col, round(CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE greatest(-0.1, least(0.1, v)) END, 6) AS v FROM x')
def matrix_clip_fill_transpose(spark, sf_dir):
    return matrix.transpose(matrix.fill(matrix.clip(holes(spark, sf_dir), -0.1, 0.1), 0.0)).select("row", "col", F.round("v", 6).alias("v"))


@query(f'{HOLES}, y AS (SELECT "row", col, round(coalesce((x.v + m.v) / 2, m.v), 6) AS mean, round(x.v * m.v, 6) AS product, round(x.v / m.v, 6) AS quotient FROM x JOIN m USING ("row", col)) SELECT "row", CAST(col AS INT) AS col, mean, product, quotient FROM y')
def matrix_arithmetic(spark, sf_dir):
    x, m = holes(spark, sf_dir), cells(spark, sf_dir)
    each = [matrix.combine(x, m, op).select("row", "col", F.round("v", 6).alias(name)) for op, name in (("mean", "mean"), ("mul", "product"), ("div", "quotient"))]
    return each[0].join(each[1], ["row", "col"]).join(each[2], ["row", "col"])


def scaled(smooth: int) -> str:
    return f"""{CELLS}, d AS (SELECT p.p AS cell, col, avg(v) AS v FROM m, generate_series(0, 9) AS p(p) WHERE "row" BETWEEN p.p * (SELECT (max(vec_id) + 1) // 10 FROM embeddings) AND (p.p + 1) * (SELECT (max(vec_id) + 1) // 10 FROM embeddings) GROUP BY 1, 2)
SELECT a.cell AS cell, CAST(a.col AS INT) AS col, round(avg(b.v), 6) AS v FROM d a JOIN d b ON b.col = a.col AND abs(b.cell - a.cell) <= {smooth} GROUP BY 1, 2"""


@query(scaled(1))
def matrix_downscale_rows(spark, sf_dir):
    return matrix.downscale_rows(cells(spark, sf_dir), 10, smooth=1)


@query(f'{CELLS} SELECT "row", round(sum(v * (greatest(abs(col - 31.5::DOUBLE), 2.0::DOUBLE) ** -1.0) / (2.0::DOUBLE ** -1.0)) / count(v), 6) AS mean FROM m GROUP BY "row"')
def exp_weighted_mean(spark, sf_dir):
    return matrix.exp_weighted_mean(cells(spark, sf_dir), 64, 2.0, -1.0)


@query(f'{CELLS} SELECT a."row", CAST(a.col AS INT) AS col, round(a.v + b.v, 6) AS v FROM m a JOIN m b ON b."row" = (SELECT max(vec_id) FROM embeddings) - a."row" AND b.col = 63 - a.col')
def matrix_sum_inverted(spark, sf_dir):
    m = cells(spark, sf_dir)
    sized = m.crossJoin(F.broadcast(m.agg((F.max("row") + 1).alias("n_rows"))))
    return matrix.combine(m, matrix.inverted(sized, F.col("n_rows"), 64), "sum").withColumn("v", F.round("v", 6))


# ---- peaks ----------------------------------------------------------------------------

def bins_sql(reads_: str = "v_reads", contigs_: str = "v_contigs") -> str:
    return f"""WITH cv AS (SELECT contig, rg AS sample, pos, count(*) AS depth FROM (SELECT contig, rg, unnest(generate_series(st, en)) AS pos FROM {reads_}) GROUP BY ALL),
all_bins AS (SELECT s.contig, s.sample, b.b AS bin FROM (SELECT DISTINCT c.contig, t.rg AS sample, c.len FROM {contigs_} c, {reads_} t) s, unnest(generate_series(0, s.len // {PEAK_BIN})) AS b(b)),
bins AS (SELECT a.contig, a.sample, CAST(a.bin AS BIGINT) AS bin, CAST(coalesce(max(depth), 0) AS BIGINT) AS cov FROM all_bins a LEFT JOIN cv ON cv.contig = a.contig AND cv.sample = a.sample AND cv.pos // {PEAK_BIN} = a.bin GROUP BY ALL)"""


BINS = bins_sql()


def bins(spark: SparkSession, sf_dir: str, of=views.reads) -> DataFrame:
    """Coverage by bin, read more than once: computed once, into the shared folder."""
    r, c = of(spark, sf_dir), views.contigs(spark, sf_dir, of)
    keyed = r.withColumn("contig", F.concat_ws("|", "contig", "rg"))
    pairs_ = c.crossJoin(F.broadcast(r.select("rg").distinct())).select(F.concat_ws("|", "contig", "rg").alias("contig"), "len")
    found = coverage.depth_runs(keyed, pairs_)
    part = lambda i, name: F.substring_index("contig", "|", i).alias(name)
    return cut(peaks.dense_bins(found.select(part(1, "contig"), part(-1, "sample"), "st", "en", "depth"), c, PEAK_BIN))


@query(f"{BINS} SELECT * FROM bins", ("v_reads", "v_contigs"))
def peak_bins(spark, sf_dir):
    return bins(spark, sf_dir)


@query(f"{BINS} SELECT contig, sample, bin, cov, round((lead(cov) OVER o - lag(cov) OVER o) / 2.0::DOUBLE, 6) AS slope FROM bins WINDOW o AS (PARTITION BY contig, sample ORDER BY bin)", ("v_reads", "v_contigs"))
def peak_derivative(spark, sf_dir):
    return peaks.derivative(bins(spark, sf_dir))


def segments_sql(reads_: str = "v_reads", contigs_: str = "v_contigs", parity: bool = False) -> str:
    """The state machine, a step a bin: all contigs and samples walk side by side."""
    run = "CASE WHEN r.done THEN {} ELSE r.run + s.x END".format("0.0" if parity else "s.x")
    before = "CASE WHEN r.done THEN 0.0 ELSE r.run END"
    on = f"((r.start IS NOT NULL AND NOT r.done) OR ({before} <= 0 AND {run} > 0))"
    inside = "r.start IS NOT NULL AND NOT r.done"
    body = bins_sql(reads_, contigs_)[5:]
    return f"""WITH RECURSIVE {body},
s AS MATERIALIZED (SELECT contig, sample, bin, cov, coalesce((lead(cov) OVER o - lag(cov) OVER o) / 2.0::DOUBLE, 0.0) AS x, row_number() OVER o AS i FROM bins WINDOW o AS (PARTITION BY contig, sample ORDER BY bin)),
r AS (SELECT contig, sample, 0::BIGINT AS i, 0.0::DOUBLE AS run, NULL::BIGINT AS start, NULL::BIGINT AS "end", -1::BIGINT AS height, NULL::BIGINT AS summit, 0::BIGINT AS area, false AS done FROM s GROUP BY 1, 2
UNION ALL SELECT s.contig, s.sample, s.i, {run}, CASE WHEN {on} THEN CASE WHEN {inside} THEN r.start ELSE s.bin END END, s.bin, CASE WHEN {on} THEN CASE WHEN {inside} THEN greatest(r.height, s.cov) ELSE s.cov END ELSE -1 END,
CASE WHEN {on} THEN CASE WHEN {inside} AND r.height >= s.cov THEN r.summit ELSE s.bin END END, CASE WHEN {on} THEN CASE WHEN {inside} THEN r.area + s.cov ELSE s.cov END ELSE 0 END, {on} AND {run} <= 0 AND {before} > {run}
FROM r JOIN s ON s.contig = r.contig AND s.sample = r.sample AND s.i = r.i + 1),
seg AS MATERIALIZED (SELECT contig, sample, start, "end", height, summit, area FROM r WHERE done)"""


MERGED = """, mo AS (SELECT *, max("end") OVER (PARTITION BY contig, sample ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
mg AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, sample ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM mo),
merged AS (SELECT contig, sample, min(start) AS start, max("end") AS "end", max(height) AS height, CAST(sum(area) AS BIGINT) AS area FROM mg GROUP BY contig, sample, g)"""
CENTRED = f"""{MERGED}, cj AS (SELECT m.contig, m.sample, m.start, m."end", m.height, b.bin, sum(b.cov) OVER (w ORDER BY b.bin) AS cum, sum(b.cov) OVER w AS total
FROM merged m JOIN bins b ON b.contig = m.contig AND b.sample = m.sample AND b.bin BETWEEN m.start AND m."end" AND b.cov > 0.2::DOUBLE * m.height WINDOW w AS (PARTITION BY m.contig, m.sample, m.start, m."end", m.height)),
centred AS (SELECT contig, sample, start, "end", height, min(bin) AS summit FROM cj WHERE cum * 2 >= total GROUP BY ALL)"""
GROUPS_SQL = f"""{CENTRED}, go AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY start, "end", sample, summit) AS i FROM centred),
gr AS (SELECT contig, i, summit AS low, 1 AS part FROM go WHERE i = 1 UNION ALL
SELECT o.contig, o.i, CASE WHEN o.summit - r.low < 3 THEN least(r.low, o.summit) ELSE o.summit END, CASE WHEN o.summit - r.low < 3 THEN r.part ELSE r.part + 1 END FROM gr r JOIN go o ON o.contig = r.contig AND o.i = r.i + 1),
gp AS (SELECT o.*, r.part FROM go o JOIN gr r ON r.contig = o.contig AND r.i = o.i), ga AS (SELECT contig, part, min(start) AS f, max("end") AS t FROM gp GROUP BY 1, 2),
gb AS (SELECT *, CASE WHEN f - lag(t) OVER (PARTITION BY contig ORDER BY part) < 3 THEN 0 ELSE 1 END AS new FROM ga), gi AS (SELECT contig, part, CAST(sum(new) OVER (PARTITION BY contig ORDER BY part) - 1 AS BIGINT) AS group_id FROM gb)
SELECT p.contig, group_id, min(start) AS start, max("end") AS "end", max(height) AS height, arg_max(summit, height * 1000000000 - summit) AS summit, count(*) AS n_peaks, count(DISTINCT sample) AS n_samples, max("end") - min(start) AS width
FROM gp p JOIN gi ON gi.contig = p.contig AND gi.part = p.part GROUP BY 1, 2"""


def found_peaks(spark: SparkSession, sf_dir: str, of=views.reads, parity: bool = False) -> DataFrame:
    return peaks.segments(peaks.derivative(bins(spark, sf_dir, of)), parity=parity)


def summits(spark: SparkSession, sf_dir: str, of=views.reads) -> DataFrame:
    b = bins(spark, sf_dir, of)
    return peaks.recentre(cut(peaks.merge_close(peaks.segments(peaks.derivative(b)))), b)


PEAK_VIEWS = ("v_reads", "v_contigs")
SPREAD_VIEWS = ("v_spread", "v_spread_contigs")
TOP_SQL = ", tr AS (SELECT *, CAST(row_number() OVER (PARTITION BY contig, sample ORDER BY height DESC, start) AS INT) AS rank FROM seg) SELECT * FROM tr WHERE rank <= 3"


@query(f"{segments_sql()} SELECT * FROM seg", PEAK_VIEWS)
def peak_segments(spark, sf_dir):
    return found_peaks(spark, sf_dir)


@query(f"{segments_sql(*SPREAD_VIEWS)} SELECT * FROM seg", SPREAD_VIEWS)
def peak_segments_spread(spark, sf_dir):
    return found_peaks(spark, sf_dir, views.spread)


@query(f"{segments_sql(*SPREAD_VIEWS, parity=True)} SELECT * FROM seg", SPREAD_VIEWS)
def peak_segments_parity(spark, sf_dir):
    return found_peaks(spark, sf_dir, views.spread, parity=True)


@query(f"{segments_sql()}{MERGED} SELECT * FROM merged", PEAK_VIEWS)
def peak_merge(spark, sf_dir):
    return peaks.merge_close(found_peaks(spark, sf_dir))


@query(f"{segments_sql(*SPREAD_VIEWS)}{MERGED} SELECT * FROM merged", SPREAD_VIEWS)
def peak_merge_spread(spark, sf_dir):
    return peaks.merge_close(found_peaks(spark, sf_dir, views.spread))


@query(f"{segments_sql()}{CENTRED} SELECT * FROM centred", PEAK_VIEWS)
def peak_summit(spark, sf_dir):
    return summits(spark, sf_dir)


@query(f"{segments_sql(*SPREAD_VIEWS)}{CENTRED} SELECT * FROM centred", SPREAD_VIEWS)
def peak_summit_spread(spark, sf_dir):
    return summits(spark, sf_dir, views.spread)


@query(f"{segments_sql()}{GROUPS_SQL}", PEAK_VIEWS)
def peak_groups(spark, sf_dir):
    return peaks.group_summary(peaks.groups(summits(spark, sf_dir)))


@query(f"{segments_sql(*SPREAD_VIEWS)}{GROUPS_SQL}", SPREAD_VIEWS)
def peak_groups_spread(spark, sf_dir):
    return peaks.group_summary(peaks.groups(summits(spark, sf_dir, views.spread)))


@query()
def peak_clusters(spark, sf_dir):
    return peaks.clusters(found_peaks(spark, sf_dir))


@query(f"{segments_sql()}{TOP_SQL}", PEAK_VIEWS)
def peak_top(spark, sf_dir):
    return peaks.top_k(found_peaks(spark, sf_dir), 3)


@query(f"{segments_sql(*SPREAD_VIEWS)}{TOP_SQL}", SPREAD_VIEWS)
def peak_top_spread(spark, sf_dir):
    return peaks.top_k(found_peaks(spark, sf_dir, views.spread), 3)


REGION = "CAST(bin // 20 AS BIGINT)"


@query(
    f"""{BINS}, t AS (SELECT rg AS sample, count(*) AS n_reads FROM v_reads GROUP BY rg),
p AS (SELECT contig, {REGION} AS region, b.sample, 1e9::DOUBLE * sum(cov) / (19 * any_value(n_reads)) AS rpkm FROM bins b JOIN t ON t.sample = b.sample GROUP BY 1, 2, 3)
SELECT contig, region, count(*) AS n_samples, round(CASE WHEN count(*) = 1 THEN max(rpkm) WHEN min(rpkm) = 0 THEN -max(rpkm) ELSE max(rpkm) / min(rpkm) - 1 END, 6) AS score FROM p GROUP BY 1, 2""",
    ("v_reads", "v_contigs"),
)
def peak_diff_rpkm(spark, sf_dir):
    b = bins(spark, sf_dir)
    regions = b.select("contig", F.expr("bin div 20").alias("region")).distinct().withColumn("start", F.col("region") * 20).withColumn("end", F.col("region") * 20 + 19)
    totals = views.reads(spark, sf_dir).groupBy(F.col("rg").alias("sample")).agg(F.count("*").alias("n_reads"))
    return peaks.rpkm_diff(regions, b, totals)


@query(f"{BINS} SELECT contig, {REGION} AS region, CAST(sum(cov * CASE WHEN (dr - 1) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS score FROM (SELECT *, dense_rank() OVER (ORDER BY sample) AS dr FROM bins) GROUP BY 1, 2", ("v_reads", "v_contigs"))
def peak_diff_simple(spark, sf_dir):
    return peaks.simple_diff(bins(spark, sf_dir).withColumnRenamed("cov", "height"), F.expr("bin div 20"))


# ---- nucleosomes ----------------------------------------------------------------------


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("contig"), F.col("event_id").alias("pos"), (F.col("value") % 100 / 100).alias("score"))


@query(
    """WITH h AS (SELECT least(999, CAST(floor(value % 100 / 100 * 1000) AS INT)) AS bin, count(*) AS n FROM events GROUP BY 1),
a AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above, sum(n) OVER () AS total FROM h) SELECT max(bin) / 1000 AS cutoff FROM a WHERE above >= floor(total * 15 / 100 + 0.5)"""
)
def nucleosome_cutoff(spark, sf_dir):
    return nucleosome.cutoff(nucleosome.score_histogram(scores(spark, sf_dir)), 15)


@query(
    """WITH RECURSIVE sc AS (SELECT user_id % 5 AS contig, event_id AS pos, value % 100 / 100 AS score FROM events), nb AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY pos, score) AS i FROM sc),
w AS (SELECT contig, i, max({'s': score, 'b': -i, 'p': pos}) OVER (PARTITION BY contig ORDER BY i ROWS 184 PRECEDING) AS best FROM nb),
cand AS MATERIALIZED (SELECT DISTINCT contig, best.p AS pos, best.s AS score FROM w WHERE i >= 185 AND best.s >= 0.5),
hop AS MATERIALIZED (SELECT a.contig, a.pos, b.pos AS next FROM cand a ASOF LEFT JOIN cand b ON a.contig = b.contig AND a.pos + 185 < b.pos),
pick AS (SELECT contig, min(pos) AS pos FROM cand GROUP BY contig UNION ALL SELECT h.contig, h.next FROM pick p JOIN hop h ON h.contig = p.contig AND h.pos = p.pos WHERE h.next IS NOT NULL)
SELECT c.* FROM pick p JOIN cand c ON c.contig = p.contig AND c.pos = p.pos"""
)
def nucleosome_centres(spark, sf_dir):
    return nucleosome.centres(scores(spark, sf_dir), 185, 0.5)


# ---- walkers --------------------------------------------------------------------------


@query("SELECT contig, count(*) AS n, CAST(sum(en - st + 1) AS BIGINT) AS total, max(en) AS furthest FROM v_reads WHERE mapq >= 20 GROUP BY contig", ("v_reads",))
def walker_by_contig(spark, sf_dir):
    """A user's walker over reads, folded by contig."""
    return walkers.run(READ_LENGTHS, views.reads(spark, sf_dir), ["contig"])


@query("SELECT count(*) AS n, CAST(sum(en - st + 1) AS BIGINT) AS total, max(en) AS furthest FROM v_reads WHERE mapq >= 20", ("v_reads",))
def walker_over_all(spark, sf_dir):
    """The same walker over all reads, its states merged in a tree."""
    return walkers.run(READ_LENGTHS, views.reads(spark, sf_dir))


READ_LENGTHS = walkers.Walker(
    needs=["st", "en", "mapq"],
    keep="mapq >= 20",
    start=lambda: (0, 0, 0),
    add=lambda s, r: (s[0] + 1, s[1] + r["en"] - r["st"] + 1, max(s[2], r["en"])),
    merge=lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])),
    finish=lambda s: [s],
    schema="n long, total long, furthest long",
)


@query("SELECT ctx, neg, count(*) AS n, count(*) FILTER (c > t) AS more FROM v_cyt WHERE q % 2 = 0 GROUP BY 1, 2", ("v_cyt",))
def cytosine_counter(spark, sf_dir):
    return methylation.count_cytosines(views.cytosines(spark, sf_dir), ["ctx", "neg"], F.col("q") % 2 == 0, {"more": F.count_if(F.col("c") > F.col("t"))})


@query(
    f"""{BINS}, p AS (SELECT contig, {REGION} AS region, sample, max(cov) AS height FROM bins GROUP BY 1, 2, 3)
SELECT contig, region, count(*) AS n_samples, CAST(max(height) - min(height) AS BIGINT) AS score FROM p GROUP BY 1, 2""",
    ("v_reads", "v_contigs"),
)
def peak_score_strategy(spark, sf_dir):
    """A user's score of regions: how far the samples' heights lie apart."""
    return peaks.scored(bins(spark, sf_dir), F.expr("bin div 20"), F.max("cov"), F.max("value") - F.min("value"))


# ---- formats --------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT s_suppkey AS line, s_suppkey % 3 AS contig, s_suppkey * 15 AS start, s_suppkey * 15 + 20 AS e, s_acctbal AS score, '+' AS strand FROM supplier)
SELECT contig, CASE WHEN start >= lag(start) OVER o AND start <= lag(e) OVER o THEN lag(e) OVER o + 1 ELSE start END AS start, e AS "end", 'el' || row_number() OVER o AS name, coalesce(score, 50.0) AS score, strand FROM f WINDOW o AS (ORDER BY line)"""
)
def gff_to_bed(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    return sinks.gff_to_bed(s.select(F.col("s_suppkey").alias("line"), (F.col("s_suppkey") % 3).alias("contig"), (F.col("s_suppkey") * 15).alias("start"), (F.col("s_suppkey") * 15 + 20).alias("end"), F.col("s_acctbal").alias("score"), F.lit("+").alias("strand")))


@query("SELECT name || '/' || CASE WHEN first THEN 1 ELSE 2 END AS name, contig, st, mapq > 20 AS paired, CASE WHEN mapq > 20 THEN first ELSE false END AS first_of_pair, CASE WHEN mapq > 20 THEN NOT first ELSE false END AS second_of_pair FROM v_reads", ("v_reads",))
def pair_flag_fix(spark, sf_dir):
    r = views.reads(spark, sf_dir).select(F.concat("name", F.when(F.col("first"), "/1").otherwise("/2")).alias("name"), "contig", "st", (F.col("mapq") > 20).alias("paired"), F.lit(False).alias("first_of_pair"), F.lit(False).alias("second_of_pair"))
    return reads.fix_pair_flags(r)


@query(f"SELECT ctx, contig || chr(9) || pos || chr(9) || pos || chr(9) || CAST(floor(100 * level + 0.5) AS INT) AS value FROM (SELECT *, {PLAIN} AS level FROM v_cyt) WHERE level IS NOT NULL", ("v_cyt",))
def bed_lines(spark, sf_dir):
    track = views.cytosines(spark, sf_dir).withColumn("level", bases.meth(F.col("c"), F.col("t"))).where("level IS NOT NULL")
    return sinks.bed_lines(track).select("ctx", "value")
