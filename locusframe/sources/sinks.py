"""Writers.  Each makes lines as a DataFrame first, so that a format is tested without files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.bases import percent
from locusframe.operators.spans import ranked_all, with_halo


def tabbed(*cols: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def write_lines(lines: DataFrame, path: str, by: list[str] | None = None) -> None:
    """``lines``: value, order columns ``_o*`` and the partition columns."""
    order = [c for c in lines.columns if c.startswith("_o")]
    keys = by or []
    (lines.repartition(*keys) if keys else lines.repartitionByRange(*order)).sortWithinPartitions(*keys, *order).select("value", *keys).write.partitionBy(*keys).text(path)


def wig_fixed(bins: DataFrame, step: int, name: str) -> DataFrame:
    """fixedStep lines of ``contig, bin, v``: a header at each start of a stretch."""
    w = Window.partitionBy("contig").orderBy("bin")
    new = F.coalesce(F.col("bin") - F.lag("bin").over(w) != 1, F.lit(True))
    b = bins.withColumn("new", new)
    head = b.where("new").select("contig", "bin", F.lit(0).alias("_k"), F.format_string(f"fixedStep  chrom=%s start=%d step={step} span={step}", "contig", F.col("bin") * step + 1).alias("value"))
    body = b.select("contig", "bin", F.lit(1).alias("_k"), F.format_string("%f", F.col("v").cast("double")).alias("value"))
    track = bins.limit(1).select(F.lit("").alias("contig"), F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("_k"), F.lit(f"track type=wiggle_0 name={name}").alias("value"))
    return track.unionByName(head).unionByName(body).select("value", F.col("contig").alias("_o1"), F.col("bin").alias("_o2"), F.col("_k").alias("_o3"))


def wig_variable(track: DataFrame) -> DataFrame:
    """variableStep lines of ``contig, pos, ctx, level``, apart by context."""
    head = track.select("contig", "ctx").distinct().select("ctx", F.col("contig").alias("_o1"), F.lit(0).cast("long").alias("_o2"), F.format_string("variableStep chrom=%s", "contig").alias("value"))
    body = track.select("ctx", F.col("contig").alias("_o1"), F.col("pos").cast("long").alias("_o2"), tabbed(F.col("pos"), percent(F.col("level"))).alias("value"))
    return head.unionByName(body)


def bed_lines(track: DataFrame) -> DataFrame:
    return track.select("ctx", F.col("contig").alias("_o1"), F.col("pos").alias("_o2"), tabbed(F.col("contig"), F.col("pos"), F.col("pos"), percent(F.col("level"))).alias("value"))


def csv_lines(track: DataFrame, numbers: DataFrame) -> DataFrame:
    """Chromosome number, position, strand, percent and reads; ``numbers``: contig, number."""
    t = track.join(F.broadcast(numbers), "contig")
    return t.select("ctx", F.col("number").alias("_o1"), F.col("pos").alias("_o2"), F.concat_ws(",", "number", "pos", "strand", percent(F.col("level")), "n_reads").alias("value"))


def bedgraph_lines(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("contig").alias("_o1"), F.col("span_start").alias("_o2"), tabbed(F.col("contig"), F.col("span_start"), F.col("span_end"), F.col("value")).alias("value"))


def gtf_centres(centres: DataFrame) -> DataFrame:
    name = F.concat(F.lit('gene_id "'), F.col("contig"), F.lit("-"), F.col("pos"), F.lit('"'))
    return centres.select(F.col("contig").alias("_o1"), F.col("pos").alias("_o2"), tabbed(F.col("contig"), F.lit("Kap08"), F.lit("exon"), F.col("pos"), F.col("pos"), F.col("score"), F.lit("+"), F.lit("."), name).alias("value"))


def logo_lines(matrix: DataFrame) -> DataFrame:
    """A PO header with the offsets and a line a base, from ``offset, a, c, g, t``."""
    cols = F.sort_array(F.collect_list(F.struct("offset", "a", "c", "g", "t")))
    one = matrix.agg(cols.alias("m"))
    head = one.select(F.lit(0).alias("_o1"), F.concat_ws(" ", F.lit("PO"), F.transform("m", lambda x: (x["offset"]).cast("string"))).alias("value"))
    for i, b in enumerate("acgt", 1):
        head = head.unionByName(one.select(F.lit(i).alias("_o1"), F.concat_ws(" ", F.lit(b.upper()), F.col(f"m.{b}").cast("array<string>")).alias("value")))
    return head


def fasta_lines(hits: DataFrame) -> DataFrame:
    """A name with contig, position, strand and methylated reads, and the sequence, from ``contig, pos, strand, meth, seq``."""
    name = F.concat(F.lit("> "), F.col("contig"), F.lit("-"), F.col("pos"), F.col("strand"), F.lit(":"), F.col("meth"), F.lit("m"))
    return hits.select(F.col("contig").alias("_o1"), F.col("pos").alias("_o2"), F.concat(name, F.lit("\n"), F.col("seq")).alias("value"))


def gff_to_bed(features: DataFrame) -> DataFrame:
    """BED rows in file order (column ``line``): names el1, el2, ...; a score of '.' is 50; a
    start within the previous interval moves behind it, whatever the contig."""
    dealt = with_halo(ranked_all(features, ["line"], "_rank"), [], "_rank", 1)
    w = Window.partitionBy("_s").orderBy("_rank")
    prev_s, prev_e = F.lag("start").over(w), F.lag("end").over(w)
    start = F.when((F.col("start") >= prev_s) & (F.col("start") <= prev_e), prev_e + 1).otherwise(F.col("start"))
    rows = dealt.withColumn("_start", start).where("_own")
    return rows.select("contig", F.col("_start").alias("start"), "end", F.concat(F.lit("el"), F.col("_rank")).alias("name"), F.coalesce(F.col("score"), F.lit(50.0)).alias("score"), "strand")


def peak_lines(groups: DataFrame) -> DataFrame:
    """Peaks of all contigs: contig, start, end and the height, between commas."""
    return groups.select(F.col("contig").alias("_o1"), F.col("start").alias("_o2"), F.concat_ws(",", "contig", "start", "end", "height").alias("value"))


def autocorr_lines(histogram: DataFrame) -> DataFrame:
    """Six counts by distance, with a header."""
    cols = ["dist", "n_m", "n_u", "n_mm", "n_mu", "n_um", "n_uu"]
    head = histogram.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_o1"), F.lit("Distance,nM,nU,nMM,nMU,nUM,nUU").alias("value"))
    return head.unionByName(histogram.select(F.col("dist").cast("long").alias("_o1"), F.concat_ws(",", *cols).alias("value")))


def summary_html(summary: DataFrame, most: int = 100_000) -> str:
    """An HTML table of a summary, a row a context; beyond ``most`` rows it is an error."""
    cols = summary.columns
    found = summary.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a summary of more than {most} rows isn't for one page")
    rows = "".join("<TR>" + "".join(f"<TD>{r[c]}</TD>" for c in cols) + "</TR>" for r in found)
    return "<TABLE><TR>" + "".join(f"<TH>{c}</TH>" for c in cols) + f"</TR>{rows}</TABLE>"


def report_lines(row: DataFrame) -> DataFrame:
    """``#name=value`` lines of a one-row frame."""
    return row.select(F.explode(F.array(*[F.concat(F.lit(f"#{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NaN"))) for c in row.columns])).alias("value"))
