"""Language of a text by a bidirectional gated recurrent network over its bytes (operator 6).

The network is trained here, in numpy, by backpropagation through time, on windows from a
bounded sample of labelled texts.  It reads every byte of every text in windows of
``WINDOW`` bytes, labels each position and averages the positions' probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import gathered, released, small_batches, utf8

WINDOW = 64
HIDDEN = 12  # a direction
#: Bounds of the training sample: documents a language, windows a document.
DOCS, WINDOWS = 300, 4
EPOCHS, BATCH, RATE = 6, 128, 0.02
BLOCK = 1 << 19  # bytes gathered at once
AT_ONCE = 1 << 17  # bytes labelled at once: arrays that stay in a core's cache
PAD = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    langs: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], seed: int = 6) -> Net:
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(langs)
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * h)).astype(np.float32)
            p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        p["o"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        p["c"] = np.zeros(k, np.float32)
        return Net(langs, p)

    def pass_one(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, row, unit) of one direction, and what training needs."""
        h = HIDDEN
        table, u = self.p[f"x{d}"], self.p[f"u{d}"]
        n, t = x.shape
        out = np.empty((t, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        saved = []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = table[x[:, i]]
            zr = sigmoid(g[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            gated = r * state
            cand = np.tanh(g[:, 2 * h :] + gated @ u[:, 2 * h :])
            saved.append((i, state, z, r, gated, cand))
            state = state + z * (cand - state)
            out[i] = state
        return out, saved

    def logits_of(self, x: np.ndarray, d: str) -> np.ndarray:
        """Share of one direction in the logits (time, language, row).

        Units lie along rows of contiguous windows, and gates are written with ``exp``, their
        factors in the weights: the forward pass of ``pass_one`` in half the time.
        """
        h, out = HIDDEN, self.p["o"].T
        out = np.ascontiguousarray(out[:, :h] if d == "f" else out[:, h:])
        factor = np.repeat(np.array([-1, 2], out.dtype), [2 * h, h])
        table, u = (np.ascontiguousarray((self.p[k] * factor).T) for k in (f"x{d}", f"u{d}"))
        t, n = x.shape
        logits = np.empty((t, len(out), n), out.dtype)
        state, g, zr, cand = (np.zeros((k * h, n), out.dtype) for k in (1, 3, 2, 1))
        z, r = zr[:h], zr[h:]
        with np.errstate(over="ignore"):  # 1 / inf is the gate's limit
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                np.take(table, x[i], axis=1, out=g, mode="clip")
                np.matmul(u[: 2 * h], state, out=zr)
                zr += g[: 2 * h]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                r *= state
                np.matmul(u[2 * h :], r, out=cand)
                cand += g[2 * h :]
                np.exp(cand, out=cand)  # tanh(a) = 1 - 2 / (exp(2 a) + 1)
                cand += 1
                np.divide(-2, cand, out=cand)
                cand += 1
                cand -= state
                cand *= z
                state += cand
                np.matmul(out, state, out=logits[i])
        return logits

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, row, language) of each position."""
        at = np.ascontiguousarray(x.T).astype(np.intp)
        logits = self.logits_of(at, "f")
        logits += self.logits_of(at, "b")
        logits += self.p["c"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(0, 2, 1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over all positions that aren't padding, through time both ways."""
        h = HIDDEN
        parts = {d: self.pass_one(x, d) for d in "fb"}
        hidden = np.concatenate([parts["f"][0], parts["b"][0]], axis=2)
        logits = hidden @ self.p["o"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        live = (x != PAD).T[:, :, None]
        delta = prob
        delta[:, np.arange(len(y)), y] -= 1
        delta = delta * live / max(int(live.sum()), 1)
        grad = {"o": np.einsum("tnh,tnk->hk", hidden, delta), "c": delta.sum(axis=(0, 1))}
        back = delta @ self.p["o"].T
        for d in "fb":
            own = back[:, :, :h] if d == "f" else back[:, :, h:]
            u = self.p[f"u{d}"]
            gx, gu = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u)
            carry = np.zeros((len(y), h), np.float32)
            for i, state, z, r, gated, cand in reversed(parts[d][1]):
                dh = own[i] + carry
                dcand = dh * z * (1 - cand * cand)
                dgated = dcand @ u[:, 2 * h :].T
                dz = dh * (cand - state) * z * (1 - z)
                dr = dgated * state * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                gu[:, : 2 * h] += state.T @ gates
                gu[:, 2 * h :] += gated.T @ dcand
                np.add.at(gx, x[:, i], np.concatenate([gates, dcand], axis=1))
                carry = dh * (1 - z) + dgated * r + gates @ u[:, : 2 * h].T
            grad[f"x{d}"], grad[f"u{d}"] = gx, gu
        return grad


def fit(langs: list[str], x: np.ndarray, y: np.ndarray, seed: int = 6) -> Net:
    net = Net.fresh(langs, seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(p) for k, p in net.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            grad = net.gradient(x[pick], y[pick])
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of bytes, filled up with ``PAD``; windows of each text)."""
    sizes = np.array([len(r) for r in raws], np.int64)
    counts = -(-sizes // WINDOW)
    out = np.full(int(counts.sum()) * WINDOW, PAD, np.int16)
    base = (np.cumsum(counts) - counts) * WINDOW
    joined = np.frombuffer(b"".join(raws), np.uint8)
    out[np.arange(len(joined)) + np.repeat(base - (np.cumsum(sizes) - sizes), sizes)] = joined
    return out.reshape(-1, WINDOW), counts


def learn(docs: DataFrame, fold: int = 0, folds: int = 5) -> Net | None:
    """Fit on at most ``DOCS`` documents a language (the smallest hashes of their ids)
    and ``WINDOWS`` evenly spaced windows of each, outside the held-out fold.  None
    if no document has a language and a text."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (key != fold))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = known.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= DOCS).select("doc_id", "lang")
    some = some.orderBy("lang", "doc_id").toArrow()  # DOCS rows a language
    if not some.num_rows:
        return None
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(some).distinct())

    def cuts(batches):
        for batch in batches:
            for raw, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = np.unique(np.linspace(0, max(len(raw) - WINDOW, 0), WINDOWS).astype(int))
                yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + WINDOW] for a in starts], pa.binary()), pa.array([lang] * len(starts), pa.string())], ["cut", "lang"])

    rows = docs.where(F.col("text") != "").join(picked, ["doc_id", "lang"]).select(utf8(F.col("text")).alias("text"), "lang").mapInArrow(released(cuts), "cut binary, lang string").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("lang", "ascending"), ("cut", "ascending")])
    langs = sorted(set(rows.column("lang").to_pylist()))
    at = {name: i for i, name in enumerate(langs)}
    x, _ = windows(rows.column("cut").to_pylist())
    return fit(langs, x, np.array([at[name] for name in rows.column("lang").to_pylist()]))


def predict(docs: DataFrame, net: Net | None, fold: int = 0, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if
    nothing was learned.  A null id is held out of nothing.  Equal probabilities go to the
    language first in order.  Long texts are read in blocks; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    key = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(key == fold, F.lit(False)).alias("held_out"), letter.alias("letter"), F.when(letter, utf8(F.col("text"))).otherwise(F.lit(b"")).alias("text"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    langs, block = net.langs, AT_ONCE // WINDOW

    def run(batches):
        for table in gathered(batches, "text", BLOCK):
            x, counts = windows(table.column("text").to_pylist())
            sums = np.zeros((len(x), len(langs)))
            live = np.zeros(len(x), np.int64)
            for at in range(0, len(x), block):
                part = x[at : at + block]
                seen = (part != PAD).T
                sums[at : at + block] = np.einsum("tnk,tn->nk", net.positions(part), seen)
                live[at : at + block] = seen.sum(axis=0)
            owner = np.repeat(np.arange(len(counts)), counts)
            total = np.stack([np.bincount(owner, sums[:, k], len(counts)) for k in range(len(langs))], axis=1)
            mean = total / np.maximum(np.bincount(owner, live, len(counts)), 1)[:, None]
            best = mean.argmax(axis=1)
            letters = table.column("letter").to_pylist()
            names = [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            score = np.where(letters, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(released(run), "doc_id long, held_out boolean, lang_pred string, score double")
