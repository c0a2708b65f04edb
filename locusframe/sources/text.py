"""Readers of the text formats, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.bam import FLAGS


def gff(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="contig string, source string, type string, start int, end int, score string, strand string, frame string, attributes string")
    pairs = F.filter(F.transform(F.split("attributes", ";"), lambda x: F.trim(x)), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^\S+\s*(.*)$", 1), '"', "").alias("v")))
    return raw.where(~F.col("contig").startswith("track")).withColumn("score", F.expr("try_cast(score AS DOUBLE)")).withColumn("attributes", F.map_from_entries(entries))


def fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="contig string, len long, offset long, line_bases int, line_width int")


def sequence_dict(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:([^\t]*)", 1)
    return raw.select(tag("SN").alias("contig"), tag("LN").cast("long").alias("len"), tag("UR").alias("uri"), tag("M5").alias("md5"))


def maq_pileup(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", quote="", schema="contig string, pos int, ref_base string, depth int, bases string, quals string, mapquals string, read_pos string")
    unmark = lambda c: F.regexp_replace(c, "^@", "")
    at = F.transform(F.filter(F.split("read_pos", ","), lambda x: x != ""), lambda x: x.cast("int"))
    return raw.select("contig", "pos", "ref_base", "depth", unmark("bases").alias("bases"), unmark("quals").alias("quals"), unmark("mapquals").alias("mapquals"), at.alias("read_pos"))


def nucleosome_scores(spark: SparkSession, path: str) -> DataFrame:
    """One row a coordinate; gzip is read as such."""
    raw = spark.read.csv(path, sep="\t", schema="contig string, start long, end long, scores string")
    return raw.select("contig", "start", F.posexplode(F.split("scores", ";")).alias("i", "s")).where("s <> ''").select("contig", (F.col("start") + F.col("i")).alias("pos"), F.col("s").cast("double").alias("score"))


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """Chunks ``contig, chunk_start, seq``: a file a contig record, split at '>'."""
    raw = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    name, body = F.regexp_extract("value", r"^(\S+)", 1), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", ""))
    whole = raw.select(name.alias("contig"), body.alias("seq"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(chunk))
    return whole.select("contig", F.explode(starts).alias("chunk_start"), "seq").select("contig", "chunk_start", F.substring("seq", F.col("chunk_start"), F.lit(chunk)).alias("seq"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text, as rows of the BAM reader's schema; whole tag values, all tags."""
    raw = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    f = lambda i: F.col("f")[i]
    flag = f(1).cast("int")
    ops = F.transform(F.regexp_extract_all(f(5), F.lit("([0-9]+[A-Z=])"), F.lit(1)), lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, "([0-9]+)", 1).cast("int").alias("len")))
    span = F.aggregate(F.filter(ops, lambda x: x["op"].isin(*"MDN=X")), F.lit(0), lambda s, x: s + x["len"])
    tags = F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0)))
    tag = lambda i, n=None: F.map_from_entries(F.transform(tags, lambda x: F.struct(F.substring(x, 1, 2).alias("k"), (F.substring(x, F.lit(i), F.length(x)) if n is None else F.substring(x, i, n)).alias("v"))))
    letters = F.transform(F.filter(F.split(f(10), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    rows = raw.select(
        f(0).alias("name"), f(2).alias("contig"), f(3).cast("int").alias("start"), (f(3).cast("int") + span - 1).alias("end"), f(4).cast("int").alias("mapq"),
        *[(flag.bitwiseAND(F.lit(v)) != 0).alias(k) for k, v in FLAGS.items()],
        ops.alias("cigar"), F.when(f(6) == "=", f(2)).otherwise(f(6)).alias("mate_contig"), f(7).cast("int").alias("mate_start"), f(8).cast("int").alias("template_len"), f(9).alias("bases"),
        F.when(f(10) == "*", F.array().cast("array<int>")).otherwise(letters).alias("quals"), tag(6).alias("attrs"), tag(4, 1).alias("tag_types"),
    )
    return rows.withColumn("read_group", F.col("attrs")["RG"])
