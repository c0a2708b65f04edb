"""The prefix trie of conversations (operator 13).

Every prefix of a conversation has a digest: the sum of one 96-bit hash a turn, of its
place, role and text.  Sums run over stretches of places, so even a conversation that
holds a third of all rows is no single task.  A node's members share its digest, and the
smallest of them owns it.  Ownership can't end further down, so each conversation owns a
chain of nodes to its last turn, or none; where its chain begins is found by a binary
search over depths, all conversations at once, each round a join with the minima by
digest.  The chain hangs under the owner of the node before it.  Chains are summed from
their ends up, and each chain's total is added to the nodes above its beginning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut, small_batches
from locusframe.llm.prefix import running

#: Turns in a stretch of places, and conversation ids in a piece of a node's list.
STRETCH, PIECE = 1024, 8192
WORD = r"[^\x20\x09-\x0D]+"


def digits(key: Column) -> Column:
    """96 bits of a hexadecimal digest as a whole number."""
    half = lambda start: F.conv(F.substring(key, start, 12), 16, 10).cast("decimal(38,0)")
    return (half(1) * F.lit(1 << 48).cast("decimal(18,0)") + half(13)).cast("decimal(29,0)")


def turns(rows: DataFrame) -> DataFrame:
    """``conv, place`` (from 1), ``said`` (digest of role and text), ``words``; turns in order, nulls first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256)
    read = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    read = cut(read.where("conv IS NOT NULL"))
    # equal turns are told apart by their digest, and spread by its first digits
    bucket = F.struct(F.floor(F.col("turn") / STRETCH).alias("at"), F.when(F.col("turn").isNull(), F.substring("said", 1, 3)).alias("of"))
    return running(read, ["conv"], bucket, [F.asc_nulls_first("turn"), F.col("said")], F.lit(1).cast("long"), "place").select("conv", "place", "said", "words", F.col("place_total").alias("turns"))


def rebuilt(rows: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns replaced by those of the block's first one:
    ``conv, place, said, words`` and, one row each, ``conv, depth`` (0 without turns)."""
    own = cut(turns(rows))
    sizes = own.groupBy("conv").agg(F.max("turns").alias("turns"))
    first = sizes.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = sizes.select("conv", "turns", taken.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base")).join(first, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0).cast("long"))))
    convs = cut(convs.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("depth")))
    short = own.where(F.col("place") < heads).select(F.col("conv").alias("base"), "place", "said", "words")
    heads_ = convs.select("conv", "base", "head").join(short, "base").where("place <= head").select("conv", "place", "said", "words")
    tails = own.join(convs.select("conv", "h", "head"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "said", "words")
    return cut(heads_.unionByName(tails)), convs.select("conv", "depth")


def digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, d, digest, words`` of every prefix, the empty one included."""
    one = digits(F.sha2(F.concat_ws(":", "place", "said"), 256))
    each = running(rows, ["conv"], F.floor((F.col("place") - 1) / STRETCH), [F.col("place")], one, "digest")
    each = each.select("conv", F.col("place").alias("d"), F.col("digest").cast("decimal(38,0)").alias("digest"), "words")
    return each.unionByName(convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("decimal(38,0)").alias("digest"), F.lit(0).cast("long").alias("words")))


def search(prefixes: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, depth, first, above``: the first depth that a conversation owns (depth + 1 if
    none) and the owner of the node before it.

    ``low`` is a depth that it doesn't own, with its owner; ``high`` one that it owns, or
    depth + 1.  The rounds grow with the logarithm of the longest conversation.
    """
    least = convs.agg(F.min("conv").alias("top"))  # the root's owner
    now = convs.crossJoin(F.broadcast(least))
    mine = F.col("conv") == F.col("top")
    now = cut(now.select("conv", "depth", F.when(mine, -1).otherwise(0).cast("long").alias("low"), F.when(~mine, F.col("top")).alias("above"), F.when(mine, 0).otherwise(F.col("depth") + 1).cast("long").alias("high")))
    done = []
    while True:
        open_ = now.where("high - low > 1")
        done.append(now.where("high - low <= 1"))
        if not open_.take(1):
            break
        probe = open_.withColumn("d", F.floor((F.col("low") + F.col("high")) / 2))
        probe = probe.join(prefixes.select("conv", "d", "digest"), ["conv", "d"]).join(minima.select("d", "digest", "owner"), ["d", "digest"])
        own = F.col("owner") == F.col("conv")
        now = cut(probe.select(
            "conv", "depth", F.when(own, F.col("low")).otherwise(F.col("d")).alias("low"), F.when(own, F.col("above")).otherwise(F.col("owner")).alias("above"),
            F.when(own, F.col("d")).otherwise(F.col("high")).alias("high"),
        ))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return cut(out.select("conv", "depth", F.col("high").alias("first"), "above"))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after another, joined by commas."""
    at, state = None, None
    for batch in batches:
        out = []
        for d, digest, ids in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (d, digest) != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (d, digest), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.decimal128(38, 0)), pa.array([x[2] for x in out], pa.string())], names=["d", "digest", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.decimal128(38, 0)), pa.array([state.hexdigest()], pa.string())], names=["d", "digest", "ends"])


def endings(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``d, digest, ends_sha256`` of nodes at which conversations end.

    Ids are joined in pieces of bounded size.  A node of one piece is hashed as it is; the
    others' pieces go through the hash one by one, in order, so that none is held whole.
    """
    ended = prefixes.join(convs.select("conv", F.col("depth").alias("d")), ["conv", "d"])
    pieces = ended.groupBy("d", "digest", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.concat_ws(",", F.array_sort(F.collect_list("conv")).cast("array<string>")).alias("ids"))
    pieces = cut(pieces)
    number = pieces.groupBy("d", "digest").agg(F.count("*").alias("n"))
    met = pieces.join(number, ["d", "digest"])
    small = met.where("n = 1").select("d", "digest", F.sha2("ids", 256).alias("ends_sha256"))
    large = met.where("n > 1").select("d", "digest", "ids", "piece").repartition("d", "digest").sortWithinPartitions("d", "digest", "piece").select("d", "digest", "ids")
    return small.unionByName(large.mapInArrow(hashed, "d long, digest decimal(38,0), ends string").withColumnRenamed("ends", "ends_sha256"))


def nodes(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations`` needs ``conv_id, turn, role, text``.  Rows without a conv_id are left
    out; null roles and texts are empty; turns that are equal or null are ordered by the
    digest of role and text, and repeated rows are turns of their own.  Other columns are
    ignored.  An empty table gives no rows, not even the root.
    """
    small_batches(conversations.sparkSession)
    rows, convs = rebuilt(conversations, block, heads)
    convs = cut(convs)
    prefixes = cut(digests(rows, convs))
    minima = cut(prefixes.groupBy("d", "digest").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words")))
    chains = search(prefixes, minima, convs)
    owning = chains.where("first <= depth")

    # children: the chain's next node, and chains that hang here
    hung = owning.where("above IS NOT NULL").groupBy(F.col("above").alias("owner"), (F.col("first") - 1).alias("d")).agg(F.count("*").alias("hung"))
    ends = owning.select(F.col("conv").alias("owner"), F.col("depth").alias("d"), F.lit(1).alias("last"))
    tops = owning.select(F.col("conv").alias("owner"), F.col("first").alias("d"), F.col("above"), F.lit(1).alias("top"))
    each = minima.join(hung, ["owner", "d"], "left").join(ends, ["owner", "d"], "left").join(tops, ["owner", "d"], "left")
    each = each.withColumn("n_children", F.coalesce("hung", F.lit(0)) + F.when(F.col("last") == 1, 0).otherwise(1))
    each = each.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("value", (F.col("n_convs") - 1) * F.col("words"))
    each = cut(each.withColumn("parent", F.when(F.col("top") == 1, F.col("above")).otherwise(F.col("owner"))).select("owner", "d", "digest", "n_convs", "n_children", "leaf", "value", "parent"))

    # up along a chain, then from its beginning to all nodes above
    whole = running(each, ["owner"], -F.floor(F.col("d") / STRETCH), [F.desc("d")], F.col("value"), "saved")
    inner = whole.select("d", "digest", "saved", F.lit(0).cast("long").alias("leaves"))
    sums = each.groupBy("owner").agg(F.sum("value").alias("saved"), F.sum("leaf").alias("leaves"), F.min("d").alias("from"))
    last = each.where("leaf = 1").select(F.col("owner").alias("conv"))
    up = prefixes.join(sums.select(F.col("owner").alias("conv"), "saved", "from"), "conv").where("d < from").select("d", "digest", "saved", F.lit(0).cast("long").alias("leaves"))
    leaves = prefixes.join(last, "conv").select("d", "digest", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    below = inner.unionByName(up).unionByName(leaves).groupBy("d", "digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    out = each.join(below, ["d", "digest"]).join(endings(prefixes, convs), ["d", "digest"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def oracle(block: int = 20, heads: int = 4) -> str:
    """The same nodes as SQL, by paths of turn digests; no crc32 in DuckDB, so it is spelt out bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"""WITH RECURSIVE o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, count(*) AS n FROM o GROUP BY c),
crc AS (SELECT c, CAST(c AS VARCHAR) AS s, 1 AS j, 0 AS k, CAST(4294967295 AS BIGINT) AS x FROM z UNION ALL
  SELECT c, s, CASE WHEN k = 8 THEN j + 1 ELSE j END, CASE WHEN k = 8 THEN 0 ELSE k + 1 END, CASE WHEN k = 0 THEN xor(x, CAST(ascii(substr(s, j, 1)) AS BIGINT)) ELSE x END AS y
  FROM (SELECT c, s, j, k, CASE WHEN k > 0 THEN {bit} ELSE x END AS x FROM crc) WHERE j <= length(s)),
h AS (SELECT c, xor(arg_max(x, j), 4294967295) % {heads} AS h FROM crc GROUP BY c),
b AS (SELECT z.c, h.h, least(h.h, coalesce(y.n, 0)) AS head, y.c AS base FROM z JOIN h ON h.c = z.c LEFT JOIN z y ON y.c = z.c - z.c % {block}),
t AS (SELECT b.c, o.i, role, text FROM b JOIN o ON o.c = b.base AND o.i <= b.head UNION ALL SELECT b.c, o.i - b.h + b.head, role, text FROM b JOIN o ON o.c = b.c AND o.i > b.h),
p AS (SELECT c, i AS d, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY i) AS path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM t
  UNION ALL SELECT c, 0, '', 0 FROM z),
n AS (SELECT path, any_value(d) AS d, min(c) AS owner, count(*) AS n, any_value(words) AS words FROM p GROUP BY path),
u AS (SELECT left(path, length(path) - 32) AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids, 0) AS kids, (n.n - 1) * words AS v FROM n LEFT JOIN u ON u.path = n.path),
a AS (SELECT p.path, sum(m.v) AS saved, count(*) FILTER (kids = 0) AS leaves FROM m JOIN p ON p.c = m.owner AND p.d <= m.d GROUP BY p.path),
e AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path)
SELECT m.owner AS conv_id, CAST(m.d AS BIGINT) AS depth, q.owner AS parent_conv_id, m.n AS n_convs, CAST(m.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN a ON a.path = m.path LEFT JOIN e ON e.path = m.path LEFT JOIN n q ON m.d > 0 AND q.path = left(m.path, length(m.path) - 32)"""
