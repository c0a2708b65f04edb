"""Similarity join on word shingles with a token-group matrix (operator 9).

1. A pass finds the shingles that two documents or more have, as a bitmap of fixed size.
   A document can only have a partner if three quarters of its shingles are repeated, so
   most documents end here.  A bit set in vain costs work, never a result.
2. The others are *active*: one set for each distinct set of shingles.  In the order
   (unrepeated, repeated, commoner and commoner; then by hash) two similar sets share a
   shingle among the first n - ceil(3 n / 4) + 1 of each: the postings.
3. Similar sets are partitioned into groups by their least shared posting, at most ``CAP``
   sets a group; within a group all are compared through its token lists.
4. Groups' components are tied by their leaders where these are similar.
5. What is left is exact: a set whose posting meets a group in another component, with
   members of a size and a place of the posting that allow similarity, is matched with the group's token union, a row of the token-group matrix.  Only where the
   overlap with the union reaches three quarters is the group opened and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.bpe import hashed
from locusframe.llm.common import cut, gathered, in_parts, packed_bits, release, released, small_batches, tidy, unpacked_bits, utf8
from locusframe.llm.components import components

WORDS = 5
LEAST = 75  # percent
BITS = 28  # 32 MB
HOT = 1 << 16  # very common shingles that are told apart, at most
HOT_FROM = 8  # batches that a very common shingle is in
CAP = 256  # sets of a group compared in one task
BATCH = 1 << 19  # bytes of text handled at once
HELD = 1 << 20  # hashes that are sorted and sent together
#: A-Z in lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, in order of both."""
    joined = b"\n".join(raws).translate(LOWER)
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64) + 1
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = hashed(joined, begin, end)
    owner = np.searchsorted(np.cumsum(sizes), begin, "right")
    a = np.uint64(0x9E3779B97F4A7C15)
    count = np.bincount(owner, minlength=len(raws))
    first = np.cumsum(count) - count
    texts, found = [], []
    for n in range(1, WORDS + 1):
        if n < WORDS:
            which = np.flatnonzero(count == n)
            at = first[which]
        else:
            at = np.flatnonzero(owner[WORDS - 1 :] == owner[: -WORDS + 1]) if len(word) >= WORDS else np.zeros(0, np.int64)
            which = owner[at]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = mixed(h * a + word[at + k])
        texts.append(which)
        found.append(h)
    text, h = np.concatenate(texts).astype(np.int64), np.concatenate(found)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def prints(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit print) of each text's set."""
    size = np.bincount(text, minlength=n)
    out = np.zeros(n, np.uint64)
    if len(h):
        some = np.flatnonzero(size)
        out[some] = mixed(np.add.reduceat(mixed(h * np.uint64(3)), (np.cumsum(size) - size)[some]) + size[some].astype(np.uint64))
    return size, out.view(np.int64)


def repeated(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(bitmap of the shingles in two different sets or more, very common shingles by their
    leading ``lead + 40`` bits, how common each is, lead)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lead = int(np.clip(np.ceil(np.log2(max(size, 1) / (1 << 22))), 6, 20))

    def packets(h, sign):
        order = np.lexsort((sign, h))
        h, sign = h[order], sign[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        many = np.zeros(int(new.sum()), bool)
        many[(np.cumsum(new) - 1)[1:][~new[1:] & (sign[1:] != sign[:-1])]] = True
        h = h[new]
        bucket = (h >> np.uint64(64 - lead)).astype(np.int64)
        rest = np.ascontiguousarray(h << np.uint64(lead) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(h)), strict=True):
            own = many[a:b]
            out.append((int(bucket[a]), rest[a:b][~own].tobytes(), rest[a:b][own].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "once", "many"])

    def send(batches):
        held, signs, n = [], [], 0
        for table in gathered(batches, "text", BATCH):
            raws = table.column("text").to_pylist()
            text, h = shingles(raws)
            _, sign = prints(text, h, len(raws))
            held.append(h), signs.append(sign[text])
            n += len(h)
            if n >= HELD:
                yield from packets(np.concatenate(held), np.concatenate(signs))
                held, signs, n = [], [], 0
        if n:
            yield from packets(np.concatenate(held), np.concatenate(signs))

    def meet(table: pa.Table) -> pa.Table:
        release()

        def wide(parts):
            raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
            out = np.zeros((len(raw), 8), np.uint8)
            out[:, :5] = raw
            return out.view(np.uint64).ravel()

        once, many = wide(table.column("once").to_pylist()), wide(table.column("many").to_pylist())
        value, count = np.unique(np.concatenate([once, many]), return_counts=True)
        found = np.concatenate([value[count > 1], many])
        bits = np.zeros(1 << (BITS - lead), np.uint8)
        bits[(found >> np.uint64(40 - (BITS - lead))).astype(np.int64)] = 1
        common = np.flatnonzero(count >= HOT_FROM)
        common = common[np.argsort(-count[common], kind="stable")][: HOT >> max(lead - 6, 0)]
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([packed_bits(bits)], pa.binary()), "common": pa.array([value[common].astype(np.int64).tolist()], pa.list_(pa.int64())), "grade": pa.array([np.log2(count[common]).astype(np.int32).tolist()], pa.list_(pa.int32()))})

    found = texts.select("text").mapInArrow(released(send), "bucket int, once binary, many binary").groupBy("bucket").applyInArrow(meet, "bucket int, bits binary, common array<long>, grade array<int>")
    out = np.zeros((1 << lead, (1 << (BITS - lead)) // 8), np.uint8)
    hot, grades = [], []
    for b, bits, common, grade in in_parts(found):
        out[b] = unpacked_bits(bits)
        hot += [b << 40 | c for c in common]
        grades += grade
    hot = np.array(hot, np.uint64)
    order = np.argsort(hot)
    return out.ravel(), hot[order], np.array(grades, np.int64)[order], lead


def packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).tobytes()


def linked(shared: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return 100 * shared >= LEAST * (n + m - shared)


class Union:
    """The token lists of a group: its row of the token-group matrix, with the owners."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def overlap(self, q: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.token, q, "left"), np.searchsorted(self.token, q, "right")
        return int((hi > lo).sum()), lo, hi

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.bincount(self.owner[at], minlength=len(self.size))


def sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def text_hash(text: Column) -> Column:
    return F.xxhash64(utf8(text))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Sets are compared by 64-bit hashes of shingles.  A null text has no words, hence no
    shingles and no links, as has a row without an id.  Rows that repeat an id are each a
    document of their own that bears it.  An empty table gives no rows; other columns are
    ignored.  With ``by_text``, ``doc_id, text_hash, component`` instead: ``text_hash`` tells
    apart rows that share an id, and ``component``, null where there are no shingles or no
    id, is told by its texts, so it's one even if the smallest id has texts in several.
    The result's ``_tables`` are those that it reads, for ``tidy`` once it's written.
    """
    spark = small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"), *([text_hash(F.col(text_col)).alias("text_hash")] if by_text else []))
    extra = rows.columns[2:]
    shared = spark.sparkContext.broadcast(repeated(rows.where(F.col("doc_id").isNotNull())))

    def see(batches):
        bits, hot, grades, lead = shared.value
        sent: set[int] = set()
        for table in gathered(batches, "text", BATCH):
            raws = table.column("text").to_pylist()
            text, h = shingles(raws)
            size, sign = prints(text, h, len(raws))
            bit = (h >> np.uint64(64 - BITS)).astype(np.int64)
            again = bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1
            top = h >> np.uint64(24 - lead)
            at = np.minimum(np.searchsorted(hot, top), max(len(hot) - 1, 0))
            rank = again.astype(np.int64) * (1 + (np.where(hot[at] == top, grades[at], 0) if len(hot) else 0))
            need = size - (LEAST * size + 99) // 100 + 1
            alone = np.bincount(text, again == 0, len(raws)).astype(np.int64)
            off = np.cumsum(size) - size
            ids = table.column("doc_id").to_pylist()
            sets, posts = [], []
            for i in range(len(raws)):
                if not size[i] or ids[i] is None or alone[i] >= need[i] or int(sign[i]) in sent:
                    sets.append(None), posts.append(None)
                    continue
                sent.add(int(sign[i]))
                own = h[off[i] : off[i] + size[i]]
                order = np.argsort(rank[off[i] : off[i] + size[i]], kind="stable")[: need[i]]
                order = order[alone[i] :]
                sets.append(packed(own)), posts.append(own[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(size, pa.int64()), pa.array(sign, pa.int64()), pa.array(sets, pa.binary()), pa.array(posts, pa.list_(pa.int64())), pa.array(alone, pa.int64()), *[table.column(c).combine_chunks() for c in extra]],
                ["doc_id", "n_shingles", "sign", "tokens", "posts", "alone", *extra],
            )

    seen = cut(rows.mapInArrow(released(see), "doc_id long, n_shingles long, sign long, tokens binary, posts array<long>, alone long" + "".join(f", {c} long" for c in extra)))
    shared.destroy()  # `seen` is written, so nothing reads the bitmap again
    del shared  # the driver's own copy
    tidy(spark)
    active = cut(seen.where("tokens IS NOT NULL").groupBy("sign").agg(F.first("tokens").alias("tokens"), F.first(F.struct("posts", "alone")).alias("p")))
    size = F.octet_length("tokens") / 8
    # place: shingles of the set that come before in the order of step 2
    posts = active.select("sign", size.cast("long").alias("size"), "p.alone", F.posexplode("p.posts").alias("i", "token"))
    posts = posts.select("sign", "token", "size", (F.col("alone") + F.col("i")).alias("place"))
    met = posts.groupBy("token").count().where("count > 1").select("token")
    posts = cut(posts.join(met, "token"))

    # groups of similar sets, large ones in parts
    least = posts.groupBy("sign").agg(F.min("token").alias("seed"))
    parts = least.groupBy("seed").agg(F.ceil(F.count("*") / CAP).cast("int").alias("parts"))
    groups = least.join(parts, "seed").select("sign", F.xxhash64("seed", F.pmod(F.xxhash64("sign"), F.col("parts"))).alias("group"))
    # sizes of similar sets differ by a factor of 4/3 at most, so by one level at most
    level = F.floor(F.log(size) / float(np.log(1.34))).cast("int")
    groups = cut(groups.join(active.select("sign", level.alias("level")), "sign"))
    members = active.select("sign", "tokens").join(groups.select("sign", "group"), "sign")

    def within(table: pa.Table) -> pa.Table:
        sign, sets = table.column("sign").to_numpy(), sets_of(table.column("tokens"))
        union = Union(sets)
        root = list(range(len(sets)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i, q in enumerate(sets):
            _, lo, hi = union.overlap(q)
            for j in np.flatnonzero(linked(union.shared(lo, hi), union.size, len(q))).tolist():
                x, y = find(i), find(j)
                if x != y:  # a spanning forest is enough
                    root[max(x, y)] = min(x, y)
                    a.append(sign[i])
                    b.append(sign[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = cut(members.groupBy("group").applyInArrow(within, "a long, b long"))
    done = [active, posts, groups, edges]
    state = tied_by(groups.withColumn("component", F.col("sign")), edges)
    done.append(state)

    # leaders of components that share a posting
    held = posts.select("sign", "token").join(state, "sign")
    tokens = held.groupBy("token").agg(F.min("component").alias("one"))
    pairs = held.select("token", "component").distinct().join(tokens, "token").where("component <> one").select("one", F.col("component").alias("two")).distinct()
    left = active.select(F.col("sign").alias("one"), F.col("tokens").alias("x"))
    right = active.select(F.col("sign").alias("two"), F.col("tokens").alias("y"))

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    tied = pairs.join(left, "one").join(right, "two").select("one", "two", "x", "y").mapInArrow(released(compare), "a long, b long")
    tied = cut(tied)
    state = tied_by(state, tied)
    done += [tied, state]

    # sets against groups of other components
    held = posts.join(state, "sign").groupBy("token", "level", "group", "component")
    held = cut(held.agg(F.min("place").alias("place"), F.min("size").alias("least"), F.max("size").alias("most")))
    row = held.groupBy("token", "level", F.col("group").alias("other"))
    row = row.agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("place").alias("place2"), F.min("least").alias("least2"), F.max("most").alias("most2"))
    some = row.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("token")  # in several components
    query = held.join(some, "token", "left_semi").withColumn("level", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
    # similar sets of n and m share 3 (n + m) / 7 at least, so no fewer may follow the shared posting
    ask = query.join(row, ["token", "level"]).where("group < other AND (component <> lo OR component <> hi) AND 4 * most - 7 * place >= 3 * least2 AND 4 * most2 - 7 * place2 >= 3 * least")
    ask = ask.select("group", "component", F.col("other")).distinct().join(state.select("group", "component", "sign"), ["group", "component"]).select("sign", "component", F.col("other").alias("group"))
    ask = cut(ask)
    done += [held, ask]
    deal = ask.groupBy("group").agg(F.ceil(F.count("*") / CAP).cast("int").alias("deals"))
    queries = ask.join(deal, "group").withColumn("deal", F.pmod(F.xxhash64("sign"), F.col("deals")).cast("int"))
    queries = queries.join(active.select("sign", "tokens"), "sign").select("group", "deal", "sign", "component", "tokens", F.lit(True).alias("query"))
    opened = deal.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("group", "deal")
    opened = opened.join(state, "group").join(active.select("sign", "tokens"), "sign").select("group", "deal", "sign", "component", "tokens", F.lit(False).alias("query"))

    def across(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        own, asked = table.filter(pa.array(~query)), table.filter(pa.array(query))
        union = Union(sets_of(own.column("tokens")))
        component = own.column("component").to_numpy()
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.setdefault(i, i)) != i:
                root[i] = i = root[up]
            return i

        a, b = [], []
        for c, q in zip(asked.column("component").to_pylist(), sets_of(asked.column("tokens")), strict=True):
            bound, lo, hi = union.overlap(q)
            if 100 * bound < LEAST * len(q):
                continue  # no member can be similar enough
            near = component[linked(union.shared(lo, hi), union.size, len(q)) & (component != c)]
            for other in np.unique(near).tolist():
                x, y = find(c), find(other)
                if x != y:  # a spanning forest of the components is enough
                    root[max(x, y)] = min(x, y)
                    a.append(c)
                    b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    if ask.take(1):
        last = cut(queries.unionByName(opened).groupBy("group", "deal").applyInArrow(across, "a long, b long"))
        state = tied_by(state, last)
        done += [last, state]
    sets = seen.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sign").agg(F.min("doc_id").alias("low"))
    sets = cut(sets.join(state.select("sign", "component"), "sign", "left").withColumn("component", F.coalesce("component", "sign")))
    tidy(spark, *[df for df in done if hasattr(df, "_path")])  # the result reads `seen` and `sets`
    ends = sets.groupBy("component").agg(F.min("low").alias("component_id"))
    names = sets.select("sign", "component") if by_text else sets.join(ends, "component").select("sign", "component_id")
    out = seen.select("doc_id", *extra, "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("sign")).alias("sign"))
    out = out.join(names, "sign", "left")
    if by_text:
        out = out.select("doc_id", "text_hash", "component")
    else:
        out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out._tables = (seen, sets)
    return out


def tied_by(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` (sign, group, level, component) with its components tied by links between them."""
    if not edges.take(1):
        return state
    found = components(edges).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return cut(state.join(found, "component", "left").select("sign", "group", "level", F.coalesce("root", "component").alias("component")))
