"""Embedding near-duplicates by a forest of random-projection trees (operator 5).

Equal vectors count once.  Each tree splits recursively by random projections; a vector
within ``SPILL`` of a split goes down both sides.  Vectors are compared only within
leaves, in double precision; large leaves are compared block by block in as many tasks.
A pair that meets in several leaves is counted in the first of them, so links are counted
without being listed, and each leaf sends only a spanning forest of its links.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, released, small_batches
from locusframe.llm.components import components

TREES = 8
SPILL = 0.02
LEAF = 256  # vectors aimed at in a leaf
BLOCK = 1024  # vectors of a leaf compared in one task with another such block
#: Bound of the sample that places the splits; every vector is indexed.
SAMPLE = 16_384
#: Depth to which the sample places splits; below, a level's splits share one place.
PLACED = 8
MAX_DEPTH = 40


@dataclass
class Forest:
    dim: int
    depth: int
    lines: np.ndarray  # (tree, depth, dim): a direction a level
    places: list[dict[int, float]]  # of each tree: split by node, numbered 1, 2, 3, ... from the root
    level: np.ndarray  # (tree, depth): split of nodes without a place

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; a leaf's number holds its tree."""
        rows, found = [], []
        for t in range(len(self.lines)):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for d in range(self.depth):
                at = x @ self.lines[t, d]
                split = np.full(len(row), self.level[t, d])
                if d < PLACED:
                    nodes, which = np.unique(node, return_inverse=True)
                    split = np.array([self.places[t].get(int(n), self.level[t, d]) for n in nodes])[which] if len(nodes) else split
                gap = at[row] - split
                left, right = gap < SPILL, gap >= -SPILL
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            found.append(node + (np.int64(t) << 50))
        return np.concatenate(rows), np.concatenate(found)


def plant(dim: int, count: int, sample: np.ndarray, seed: int = 5) -> Forest:
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(count, 1) / LEAF)))))
    rng = np.random.default_rng([seed, dim])
    lines = rng.normal(size=(TREES, depth, dim))
    lines /= np.linalg.norm(lines, axis=2, keepdims=True)
    share = rng.uniform(0.4, 0.6, (TREES, depth))
    level, places = np.zeros((TREES, depth)), []
    for t in range(TREES):
        found: dict[int, float] = {}
        node = np.ones(len(sample), np.int64)
        for d in range(depth):
            at = sample @ lines[t, d]
            level[t, d] = np.quantile(at, share[t, d]) if len(at) else 0.0
            split = np.full(len(at), level[t, d])
            if d < PLACED:
                for n in np.unique(node):
                    own = node == n
                    if own.sum() >= 16:
                        found[int(n)] = float(np.quantile(at[own], rng.uniform(0.4, 0.6)))
                        split[own] = found[int(n)]
            node = 2 * node + (at >= split)
        places.append(found)
    return Forest(dim, depth, lines, places, level)


def unit(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, dim, key, vec``: key and vec are null for vectors that link with nothing."""
    v = F.col(vec_col).cast("array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))

    def pack(batches):
        for batch in batches:
            raws, keys, dims = [], [], []
            for v in batch.column(1):
                if not v.is_valid:
                    raws.append(None), keys.append(None), dims.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False) + 0.0
                x = x / np.abs(x).max()  # neither overflows nor vanishes when squared
                raws.append(x.tobytes())
                keys.append(hashlib.blake2b(v.values.to_numpy(zero_copy_only=False).__add__(0.0).tobytes(), digest_size=16).digest())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "dim", "key", "vec"])

    return rows.mapInArrow(released(pack), "vec_id long, dim int, key binary, vec binary")


def near(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows without an id (their component is null and they aren't kept).
    Vectors of different lengths aren't compared.  Rows that repeat an id with another
    vector are one node.  An empty table gives no rows; other columns are ignored.
    """
    spark = small_batches(df.sparkSession)
    rows = cut(prepared(df, id_col, vec_col))
    classes = cut(rows.where("key IS NOT NULL").groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    forests = {}
    for dim, count in counts.items():
        some = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toArrow().column("vec").to_pylist()
        forests[dim] = plant(dim, count, unit(some))
    shared = spark.sparkContext.broadcast(forests)

    def leaves_of(dim, x):
        forest = shared.value.get(dim)
        if forest is None:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        return forest.leaves(x)

    def route(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                row, leaf = leaves_of(int(dim), unit(part.column(3).to_pylist()))
                for at in range(0, len(row), 8192):
                    some = pa.array(row[at : at + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[at : at + 8192]), *[part.column(i).take(some) for i in range(4)]], ["leaf", "dim", "rep", "n", "vec"])

    routed = classes.select("dim", "rep", "n", "vec").mapInArrow(released(route), "leaf long, dim int, rep long, n long, vec binary")
    large = cut(routed.groupBy("dim", "leaf").count().where(F.col("count") > BLOCK).select("dim", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = routed.join(large, ["dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "vec"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "n", "vec")

    def compare(table: pa.Table) -> pa.Table:
        own, rep, n = (table.column(c).to_numpy() for c in ("own", "rep", "n"))
        dim, leaf, lo, hi = (table.column(c)[0].as_py() for c in ("dim", "leaf", "lo", "hi"))
        x = unit(table.column("vec").to_pylist())
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        left, right = [], []
        for at in range(0, len(a), 512):
            i, j = np.nonzero(x[a[at : at + 512]] @ x[b].T >= least)
            i, j = a[at + i], b[j]
            ok = i < j if lo == hi else i != j
            left.append(i[ok])
            right.append(j[ok])
        i, j = np.concatenate(left or [[]]).astype(np.int64), np.concatenate(right or [[]]).astype(np.int64)
        # the first leaf in which both of a pair are is the one that counts it
        some = np.unique(np.concatenate([i, j]))
        first = np.ones(len(i), bool)
        if len(some):
            row, found = leaves_of(dim, x[some])
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(len(some) + 1))
            before = [set(found[order[p:q]][found[order[p:q]] < leaf].tolist()) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            if any(before):
                at_i, at_j = np.searchsorted(some, i), np.searchsorted(some, j)
                first = np.array([before[p].isdisjoint(before[q]) for p, q in zip(at_i.tolist(), at_j.tolist(), strict=True)], bool)
        links = np.bincount(i[first], n[j[first]], len(x)) + np.bincount(j[first], n[i[first]], len(x)) if len(i) else np.zeros(len(x))
        root = np.arange(len(x))

        def find(p):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        kept_a, kept_b = [], []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
                kept_a.append(p)
                kept_b.append(q)
        some = np.flatnonzero(links)
        node = np.concatenate([rep[some], rep[np.array(kept_a, np.int64)]])
        to = np.concatenate([rep[some], rep[np.array(kept_b, np.int64)]])
        value = np.concatenate([links[some].astype(np.int64), np.zeros(len(kept_a), np.int64)])
        return pa.table({"node": pa.array(node, pa.int64()), "to": pa.array(to, pa.int64()), "links": pa.array(value, pa.int64())})

    found = cut(dealt.groupBy("dim", "leaf", "lo", "hi").applyInArrow(compare, "node long, to long, links long"))
    degree = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("others"))
    group = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = classes.select("dim", "key", "rep", "n").join(degree.withColumnRenamed("node", "rep"), "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    out = rows.select("vec_id", "dim", "key").join(known, ["dim", "key"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
