"""Adapter views: the driver's tables as reads, contigs, features, cytosines and sequences.

The same text serves Spark and, as common table expressions, the SQL counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.sources.shared import cut

READS = """l_returnflag AS contig, l_linestatus AS rg, l_orderkey AS name, l_partkey + 1 AS st,
l_partkey + CAST(l_quantity AS INT) AS en, l_suppkey + 1 AS mate_st, (l_linenumber % 2 = 0) AS neg,
(l_suppkey % 2 = 0) AS mate_neg, (l_linenumber % 2 = 1) AS first, CAST(round(l_tax * 1000) AS INT) AS mapq,
(l_discount > 0.085) AS not_primary, l_linenumber AS cycle"""
FEATURES = """s_suppkey AS fid, s_suppkey % 3 AS grp, s_suppkey * 100 + 1 AS fs, s_suppkey * 100 + 20 AS fe,
CASE s_nationkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand"""
CYT0 = """user_id AS contig, event_id AS pos, (event_id % 2 = 1) AS neg,
CASE event_type WHEN 'click' THEN 'ACG' WHEN 'view' THEN 'GCA' WHEN 'purchase' THEN 'TCG' WHEN 'signup' THEN 'GCT' ELSE 'CCC' END AS ctx,
CAST(floor(value) AS INT) AS q, user_id * 100 + extract(day FROM ts) AS rd"""
CYT = """contig, pos, neg, ctx, q, rd, q % 8 AS c, q % 3 AS c_nonconv, (q * 7 + 3) % 9 AS t, q % 2 AS ag,
q % 4 AS opp_a, q % 4 + q % 5 AS opp_tot, (q % 2 = 1) AS meth"""
CR = """l_returnflag AS contig, l_partkey AS pos, l_orderkey AS rd, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'WCG' WHEN 1 THEN 'GCH' ELSE 'HCH' END AS ctx"""

#: The views as DuckDB common table expressions.
SQL = {
    "v_reads": f"SELECT {READS} FROM lineitem",
    "v_contigs": "SELECT DISTINCT contig, (SELECT max(en) FROM v_reads) AS len FROM v_reads",
    # the same reads apart, one order a stretch of four positions: shallow coverage with many peaks
    "v_spread": f"SELECT contig, rg, name * 4 + 1 AS st, name * 4 + 1 + en - st AS en FROM ({READS.join(['SELECT ', ' FROM lineitem'])})",
    "v_spread_contigs": "SELECT DISTINCT contig, (SELECT max(en) FROM v_spread) AS len FROM v_spread",
    "v_features": f"SELECT {FEATURES} FROM supplier",
    "v_cyt": f"SELECT {CYT} FROM (SELECT {CYT0} FROM events)",
    "v_cr": f"SELECT contig, pos, rd, min(l_linenumber) % 2 = 1 AS meth, ctx FROM (SELECT {CR} FROM lineitem) GROUP BY contig, pos, rd, ctx",
    "v_seq": "SELECT doc_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents",
}
NEEDS = {"v_contigs": ["v_reads"], "v_spread_contigs": ["v_spread"]}


def with_views(*names: str) -> str:
    """``WITH`` and the named views, with those that they read."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*NEEDS.get(name, []), name) if n not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(text: str) -> list[str]:
    """Split a select list at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]]]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*columns(READS))


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).selectExpr("contig", "rg", "name * 4 + 1 AS st", "name * 4 + 1 + en - st AS en")


def contigs(spark: SparkSession, sf_dir: str, of=reads) -> DataFrame:
    r = of(spark, sf_dir)
    return r.select("contig").distinct().crossJoin(r.selectExpr("max(en) AS len"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*columns(FEATURES))


def cytosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*columns(CYT0)).selectExpr(*columns(CYT))


def cytosine_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(*columns(CR))
    return raw.groupBy("contig", "pos", "rd", "ctx").agg({"l_linenumber": "min"}).selectExpr("contig", "pos", "rd", "`min(l_linenumber)` % 2 = 1 AS meth", "ctx")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "regexp_replace(upper(text), '[^ACGT]', '') AS seq")


def placed(spark: SparkSession, sf_dir: str, stretch: int = 4096) -> DataFrame:
    """Whole sequences end to end on three contigs, in order of id: ``contig, id, start, seq``.

    Lengths run over stretches of ids, whose totals, a small table, carry them on.  The texts
    are searched for bases once, and what they hold is written, as all that follows reads it.
    """
    s = cut(sequences(spark, sf_dir).selectExpr("concat('chr', id % 3) AS contig", "id", "seq", f"id div {stretch} AS k", "length(seq) AS n"))
    to_here = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = s.groupBy("contig", "k").agg(F.sum("n").alias("all"))
    totals = totals.select("contig", "k", F.coalesce(F.sum("all").over(to_here("contig", "k")), F.lit(0)).alias("base"))
    s = s.withColumn("run", F.coalesce(F.sum("n").over(to_here("contig", "k", "id")), F.lit(0)))
    return s.join(totals, ["contig", "k"]).select("contig", "id", (F.col("base") + F.col("run") + 1).alias("start"), "seq")


#: The operations of the derived reads: three clipped bases, stretches apart by an insertion, a deletion and a skip, two clipped bases.
CIGAR = [(3, "S"), (12, "M"), (2, "I"), (10, "M"), (4, "D"), (8, "M"), (6, "N"), (9, "M"), (2, "S")]


def aligned(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Reads with ``cigar`` from whole placed sequences (``of``), one every 60 bases; even ones are
    converted where they lie on the reference (C to T, on the reverse strand G to A)."""
    s = (placed(spark, sf_dir) if of is None else of).where("length(seq) >= 60").selectExpr("contig", "id", "start", "seq", "explode(sequence(0, length(seq) div 60 - 1)) AS k")
    s = s.selectExpr("contig", "concat(id, ':', k) AS name", "start + 60 * k + 5 AS st", "k % 3 = 1 AS neg", "k % 4 = 3 AS second", "k", "substring(seq, 60 * k + 1, 60) AS piece")
    mid = "concat('{0}', substring(piece, 6, 12), '{1}', substring(piece, 18, 10), substring(piece, 32, 8), substring(piece, 46, 9), '{2}')".format("ACG", "TG", "CA")
    turned = f"CASE WHEN k % 2 = 1 THEN {mid} WHEN neg THEN translate({mid}, 'G', 'A') ELSE translate({mid}, 'C', 'T') END"
    ops = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).alias("len")) for n, op in CIGAR])
    return s.selectExpr("contig", "name", "st", "neg", "second", f"{turned} AS bases").withColumn("cigar", ops)
