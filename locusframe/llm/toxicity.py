"""Toxic passages by maximum-scoring segments (operator 8).

Words get log-odds under an informative Dirichlet prior; every maximal-scoring segment
of a text is found in one linear scan; a segment's score is put against the extreme-value
law of scores in clean text of that length; a logistic curve, fitted on the labelled
sample, turns a document's evidence into a probability.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, released, small_batches, tidy, utf8

#: Bound of the labelled sample that the model is fitted on; scoring covers all rows.
SAMPLE = 40_000
PRIOR = 500.0  # of prior, spread as in the whole sample, and
FLAT = 0.5  # for every word; counts are of documents that hold a word
Z = 3.0  # log-odds within so many standard errors of 0 count as none
SHRINK = 1.5  # standard errors that a positive log-odds gives up
DRIFT = -0.1  # score of a word that says nothing
ALPHA = 0.01  # passages with a smaller chance in clean text are reported
#: ASCII letters in lower case; other ASCII becomes a blank; bytes of other letters stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLDED).split()


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # of the extreme-value law
    scale: float = 0.1
    slope: float = 1.0
    bias: float = -3.0

    def dump(self) -> str:
        return json.dumps(asdict(self))


def maximal(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) in one pass; steps back follow
    pointers, each of which is followed once."""
    ends = np.cumsum(values)
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []
    for i in np.flatnonzero(values > 0).tolist():
        right = float(ends[i])
        left, start = right - float(values[i]), i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = back[j]
            if j < 0 or high[j] >= right:
                break
            left, start = low[j], first[j]
            del first[j:], last[j:], low[j:], high[j:], back[j:]
        first.append(start)
        last.append(i)
        low.append(left)
        high.append(right)
        back.append(j)
    return [(a, b, h - x) for a, b, h, x in zip(first, last, high, low, strict=True)]


def evidence(raw: bytes, scores: dict[bytes, float], rate: float, scale: float) -> tuple[int, float, list[tuple[int, int, float, float]]]:
    """(words, evidence, segments with their chance in clean text)."""
    words = words_of(raw)
    values = np.fromiter(map(scores.get, words, repeat(DRIFT)), np.float64, len(words))
    out, total = [], 0.0
    for a, b, s in maximal(values):
        surprise = rate * s - np.log(scale * max(len(words), 2))
        out.append((a, b, s, float(-np.expm1(-np.exp(-min(max(surprise, -50), 50))))))
        total += max(surprise, 0.0)
    return len(words), float(total), out


def spread(found: float) -> float:
    return float(np.log1p(found))


def law(scores: np.ndarray, share: np.ndarray) -> float:
    """The rate at which high scores thin out in clean text: sum(share * exp(rate * score)) = 1."""
    lo, hi = 1e-6, 1.0
    def over(r):
        return float((share * np.exp(np.minimum(r * scores, 700))).sum()) - 1
    if (share * scores).sum() >= 0 or not (scores > 0).any():
        return 1.0
    while over(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if over(mid) < 0 else (lo, mid)
    return hi


def learn(docs: DataFrame, labels: DataFrame, fold: int = 2, folds: int = 4) -> Model:
    """Fit on at most ``SAMPLE`` labelled documents outside the held-out fold.

    Documents with several labels count as toxic if one says so; null labels are skipped.
    Without toxic or without clean labelled documents the model knows no words.
    """
    small_batches(docs.sparkSession)
    key = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    some = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (key != fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    some = cut(some)
    held = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(F.broadcast(some), "doc_id")
    # one text of an id, so that SAMPLE bounds the rows too
    held = cut(held.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))

    def count(batches):
        from collections import Counter

        seen = [Counter(), Counter()]
        for batch in batches:
            for raw, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[1 if y else 0].update(set(words_of(raw)))
            if sum(map(len, seen)) > 100_000:
                yield from flush(seen)
                seen = [Counter(), Counter()]
        yield from flush(seen)

    def flush(seen):
        for y, words in enumerate(seen):
            names = list(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([words[w] * (1 - y) for w in names], pa.int64()), pa.array([words[w] * y for w in names], pa.int64())], ["word", "clean", "toxic"]
            )

    counts = held.select("text", "toxic").mapInArrow(released(count), "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = cut(counts)
    totals = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n0, n1 = totals["clean"] or 0, totals["toxic"] or 0
    if not n0 or not n1:
        tidy(docs.sparkSession, some, held, counts)
        return Model()
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic")) / (n0 + n1) + FLAT
    a1, a0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a1 / (n1 + PRIOR - a1)) - F.log(a0 / (n0 + PRIOR - a0))
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    rows = counts.withColumn("odds", odds).withColumn("z", z).where(F.abs("z") > Z).orderBy(F.desc(F.abs("z")), "word").collect()  # words of the sample only
    scores = {}
    share, value = [], []
    for r in rows:
        worth = r.odds * (1 - SHRINK / abs(r.z)) if r.odds > 0 else max(r.odds, -0.5)
        scores[bytes(r.word)] = worth + DRIFT
        share.append(r.clean / n0)
        value.append(worth + DRIFT)
    share.append(max(0.0, 1 - sum(share)))
    value.append(DRIFT)
    model = Model({k.decode("latin-1"): v for k, v in scores.items()}, law(np.array(value), np.array(share)))

    def weigh(batches):
        for batch in batches:
            out = [spread(evidence(raw, scores, model.rate, model.scale)[1]) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(1).cast(pa.int32())], ["x", "y"])

    fitted = held.select("text", "toxic").mapInArrow(released(weigh), "x double, y int").collect()  # SAMPLE rows at most
    model.slope, model.bias = logistic(np.array([r.x for r in fitted]), np.array([1.0 if r.y else 0.0 for r in fitted]))
    tidy(docs.sparkSession, some, held, counts)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One feature, a little ridge, by Newton steps."""
    w = np.zeros(2)
    at = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ w, -30, 30)))
        grad = at.T @ (y - p) - 1e-2 * w
        hess = (at * (p * (1 - p))[:, None]).T @ at + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: ``doc_id, score, n_words, passages``.

    ``passages`` holds first and last word, score and chance of each significant segment.
    Null and empty texts have no words and the lowest score; a null id stays null; every
    row gets a row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kept = {k.encode("latin-1"): v for k, v in model.scores.items()}
    rate, scale, slope, bias = model.rate, model.scale, model.slope, model.bias
    span = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])

    def run(batches):
        for batch in batches:
            n, p, spans = [], [], []
            for raw in batch.column(1).to_pylist():
                words, found, parts = evidence(raw, kept, rate, scale)
                n.append(words)
                p.append(float(1 / (1 + np.exp(-np.clip(slope * spread(found) + bias, -30, 30)))))
                spans.append([dict(first_word=a, last_word=b, score=s, chance=c) for a, b, s, c in parts if c < ALPHA])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(n, pa.int32()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "n_words", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(
        released(run), "doc_id long, score double, n_words int, passages array<struct<first_word:int,last_word:int,score:double,chance:double>>"
    )


def clean(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``least``, with all their columns, in one narrow pass."""
    small_batches(docs.sparkSession)
    kept = {k.encode("latin-1"): v for k, v in model.scores.items()}
    rate, scale, slope, bias = model.rate, model.scale, model.slope, model.bias

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            odds = [slope * spread(evidence(t or b"", kept, rate, scale)[1]) + bias for t in texts]
            yield batch.filter(pa.array([1 / (1 + np.exp(-np.clip(o, -30, 30))) < least for o in odds], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def held_out(column: str, fold: int, folds: int):
    """Whether crc32 of the id as text leaves that remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))
