"""Proportional stratified interleaving into shards (operator 10); DataFrame functions only.

Rows are shuffled within each source by a seeded key and get a fractional rank
(2 rank + 1) / (2 n).  In the order of fractional ranks every stretch holds the sources
in the corpus's proportions, so cutting that order into equal stretches gives shards
that match the mixture, with row counts at most one apart (law ``rows``).  No text
moves: only ids, sizes, sources and checksums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, utf8
from locusframe.llm.prefix import DIGITS, running, seeded

#: Stretches of the fractional order that are ranked apart; each holds about n / SPANS rows.
SPANS = 4096


def interleave(docs: DataFrame, shards: int = 24, seed: int = 10, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``.

    Null sources make a stratum of their own.  Null texts have size 8 and the checksum of
    no bytes.  Rows that are equal in id and text are told apart by their order alone, and
    each gets a slot.  An empty table gives no rows; other columns are ignored.
    """
    raw = utf8(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.col(source_col).alias("source"),
    )
    rows = cut(rows.withColumn("key", seeded(seed, F.col("doc_id"), F.col("text_crc32"))))
    rows = running(rows, ["source"], F.substring("key", 1, DIGITS), [F.col("key")], F.lit(1).cast("long"), "rank")
    rows = cut(rows.withColumn("part", (2 * F.col("rank") - 1) / (2 * F.col("rank_total"))).drop("rank", "rank_total"))
    span = F.least(F.floor(F.col("part") * SPANS), F.lit(SPANS - 1)).cast("int")
    rows = rows.withColumn("_all", F.lit(0))
    rows = running(rows, ["_all"], span, [F.col("part"), F.col("source"), F.col("key")], F.lit(1).cast("long"), "place")
    rows = rows.withColumn("shard", F.expr(f"CAST(((place - 1) * {shards}) div place_total AS INT)"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"place - 1 - ((shard * place_total + {shards - 1}) div {shards})").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
