"""Mixing sources to target weights by hierarchical budgets (operator 1); DataFrame functions only.

The tree is domain - language - source.  A budget of tokens goes down from the root: at
each node it is split among the children by weight, and a child that can't use its share
(its tokens times ``epochs``) leaves the rest to its siblings; as a node never gets more
than its subtree can use, a shortage reaches the ancestors' other children only when all
siblings are full.  A leaf reads whole epochs and then a prefix of one more, in that
epoch's seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut
from locusframe.llm.prefix import DIGITS, running, seeded

LEVELS = ["domain", "lang", "source"]
#: Leaves up to which the quotas are broadcast (about 100 bytes each); beyond, a shuffled join.
SMALL = 20_000
#: The domain of a source, where the table has none of its own.
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '3', '6', '9') THEN 'd0' WHEN right(source, 1) IN ('1', '4', '7') THEN 'd1' ELSE 'd2' END"
WORD = "[^\\x20\\x09-\\x0D]+"


def weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def split(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Share ``amount`` of each parent among its children (``cap``, ``w``): the largest
    equal ratio to the weights at which no child exceeds its cap.  Whole tokens, rounded down."""
    within = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = within.orderBy(F.col("cap").cast("double") / F.col("w"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    full = F.col("cap") * F.col("_w") <= (F.col("amount") - F.col("_c")) * F.col("w")
    nodes = nodes.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("w").over(rest))
    nodes = nodes.withColumn("_full", full)
    nodes = nodes.withColumn("_c", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(within))
    nodes = nodes.withColumn("_w", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(within))
    share = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("CASE WHEN _w > 0 THEN ((amount - _c) * w) div _w END"))
    return nodes.withColumn("amount", share).drop("_c", "_w", "_full", "w")


def quotas(leaves: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """``leaves``: domain, lang, source, tokens.  Adds ``amount``, the leaf's token budget."""
    num, den = share
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    domains = nodes.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    every = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("amount", F.least(F.sum("cap").over(every), F.expr(f"(sum(tokens) OVER (PARTITION BY 0) * {num}) div {den}")))
    domains = split(domains.withColumn("w", weight("domain", weights.get("domain", {}))), [], "domain").select("domain", "amount")
    langs = nodes.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = split(langs.withColumn("w", weight("lang", weights.get("lang", {}))), ["domain"], "lang").select("domain", "lang", "amount")
    nodes = nodes.join(langs, ["domain", "lang"])
    return split(nodes.withColumn("w", weight("source", weights.get("source", {}))), ["domain", "lang"], "source").select(*LEVELS, "tokens", "amount")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 2), epochs: int = 4, seed: int = 1, domain: str = DOMAIN, row: Column | None = None) -> DataFrame:
    """Select documents to the target weights; ``share`` of all tokens is the budget.

    Returns a row for each selected (document, epoch): ``doc_id, domain, lang, source,
    n_tokens, epoch``.  Tokens are words.  Null and empty names are the same node ``''``.
    Texts without words cost nothing and are taken once when their leaf's prefix reaches
    them.  Rows equal in id are told apart by their order alone.  A leaf whose next
    document doesn't fit its prefix stops there: a quota is never exceeded.  An empty
    table gives no rows; other columns are ignored.  ``row``, an expression, comes along.
    """
    more = [] if row is None else [row.alias("row")]
    rows = docs.select(
        *more,
        "doc_id",
        F.coalesce(F.expr(domain), F.lit("")).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = cut(rows)
    plan = cut(quotas(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), weights, share, epochs))
    plan = plan.withColumn("whole", F.expr("CASE WHEN tokens > 0 THEN amount div tokens ELSE 0 END")).withColumn("rest", F.expr("amount - whole * tokens"))
    plan = plan.drop("tokens", "amount")
    if plan.count() <= SMALL:
        plan = F.broadcast(plan)
    rows = rows.join(plan, LEVELS)
    rows = cut(rows.withColumn("key", seeded(seed, F.col("whole"), F.col("doc_id"))))
    rows = running(rows, LEVELS, F.substring("key", 1, DIGITS), [F.col("key"), F.col("n_tokens")], F.col("n_tokens"), "cum")
    rows = rows.withColumn("copies", F.col("whole") + (F.col("cum") <= F.col("rest")).cast("long")).where("copies > 0")
    return rows.select(*(["row"] if more else []), "doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 2), epochs: int = 4, seed: int = 1) -> DataFrame:
    """The selected documents themselves, with all their columns, once for each epoch.

    Rows are told apart by id, language, source and text.  Of rows that repeat all four as
    many come out as were selected, each time the same one.  Documents travel as one
    column, so theirs can have any names; rows without an id take part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("doc_id", "lang", "source")]
    row = F.md5(F.concat_ws(":", *[F.concat_ws(".", F.octet_length(p), p) for p in parts], text).cast("binary"))
    counted = docs.select(row.alias("row")).groupBy("row").agg(F.count("*").alias("rows"))
    taken = mix(docs, weights, share, epochs, seed, row=row).groupBy("row").agg(F.count("*").alias("copies"))
    taken = cut(taken.join(counted, "row"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row.alias("row"))
    out = whole.join(taken.where("rows = 1").drop("rows"), "row")
    again = taken.where("rows > 1").drop("rows")
    if again.take(1):
        out = out.unionByName(whole.join(again, "row").dropDuplicates(["row"]))
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def oracle(weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 2), epochs: int = 4, seed: int = 1, domain: str = DOMAIN) -> str:
    """The same rows as DuckDB SQL."""

    def w(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    def level(name: str, source: str, level_col: str, parent: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_1 AS (SELECT *, {w(level_col)} AS w FROM {source}),
{name}_2 AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr
  FROM {name}_1 WINDOW o AS ({part} ORDER BY CAST(cap AS DOUBLE) / w, {level_col})),
{name}_3 AS (SELECT * REPLACE (cap AS cap), cap * wr <= (amount - c) * w AS is_full FROM {name}_2),
{name}_4 AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS c2,
  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS w2 FROM {name}_3),
{name} AS (SELECT * EXCLUDE (amount), CASE WHEN is_full THEN cap ELSE ((amount - c2) * w) // w2 END AS amount FROM {name}_4)"""

    num, den = share
    return f"""
WITH d AS (SELECT doc_id, coalesce({domain}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {epochs} AS cap FROM d GROUP BY ALL),
dom_0 AS (SELECT domain, sum(cap) AS cap, least((SELECT sum(cap) FROM leaf), ((SELECT sum(tokens) FROM leaf) * {num}) // {den}) AS amount FROM leaf GROUP BY domain),
{level("dom", "dom_0", "domain", "")},
lng_0 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, any_value(p.amount) AS amount FROM leaf l JOIN dom p USING (domain) GROUP BY l.domain, l.lang),
{level("lng", "lng_0", "lang", "domain")},
src_0 AS (SELECT l.*, p.amount FROM leaf l JOIN lng p USING (domain, lang)),
{level("src", "src_0", "source", "domain, lang")},
q AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN amount // tokens ELSE 0 END AS whole, amount - CASE WHEN tokens > 0 THEN amount // tokens ELSE 0 END * tokens AS rest FROM src),
k AS (SELECT d.*, whole, rest, md5(concat_ws(':', '{seed}', CAST(CAST(whole AS BIGINT) AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '~'))) AS key FROM d JOIN q USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) AS cum FROM k),
c AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN cum <= rest THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(copies)) AS epoch FROM c"""
