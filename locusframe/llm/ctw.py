"""Language-model scores by context-tree weighting over bytes (operator 11).

A text is scored as its tokens: each word and a space, then one line feed for the end.
Every byte is eight binary decisions.  Each decision has a tree of contexts, the up to
``depth`` bytes before it; at each context the Krichevsky-Trofimov estimate of its counts
is mixed, half and half, with the product of what the longer contexts say.  Given the
counts of the training texts this is the exact conditional probability of the weighted
tree, so a byte costs the same wherever it stands after the same ``depth`` bytes.

How it is spread.  Texts are cut into blocks of bounded size, written once.  A block sends
each of its distinct strings of depth + 1 bytes, and each distinct word, once, packed by a
hash into parts; a part holds a bounded share of all requests, however often a string or
word occurs.  Parts sum the counts.  The trees are built in groups of the two bytes just
before, at most 256 ** (depth - 2) * 256 strings each; only the contexts of one byte and
of none (at most 65,280 decisions) meet on the driver.  Answers return to the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, released, small_batches

#: Bytes of text in a block, and of text whose requests a part answers.
BLOCK, PART = 4 << 20, 24 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"

BLOCKS = "block long, ids array<long>, rows array<long>, train array<boolean>, sizes array<int>, tokens array<int>, ends array<boolean>, raw int, data binary"


def tokens_of(text: bytes) -> list[bytes]:
    """Words between spaces, tabs, line feeds, vertical tabs, form feeds and returns."""
    return text.translate(LOWER).split()


def pieces_of(words: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """Runs of whole words of about ``limit`` bytes; one at least, even if empty."""
    at, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= limit and i + 1 < len(words):
            yield words[at : i + 1]
            at, size = i + 1, 0
    yield words[at:]


def to_blocks(depth: int, limit: int):
    """Batches of ``id, train, text`` to rows of BLOCKS.

    ``data`` holds the pieces one after another, compressed (``raw``: bytes before), each behind the ``depth`` bytes before it
    (line feeds at a text's start); ``rows`` tells which pieces are of one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = number = row = 0

        def flush():
            nonlocal held, size, number
            cols = list(zip(*[h[:-1] for h in held], strict=True))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
            data = b"".join(h[-1] for h in held)
            arrays = [pa.array([(part << 32) + number], pa.int64()), *[pa.array([list(c)], pa.list_(t)) for c, t in zip(cols, types, strict=True)], pa.array([len(data)], pa.int32()), pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary())]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for key, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                row += 1
                before = END * depth
                runs = list(pieces_of(tokens_of(text.as_buffer().to_pybytes() if text.is_valid else b""), limit))
                for i, words in enumerate(runs):
                    body = b"".join([w + b" " for w in words]) + (END if i + 1 == len(runs) else b"")
                    held.append((key, (part << 32) + row, train, len(body), len(words), i + 1 == len(runs), before + body))
                    before = (before + body)[-depth:]
                    size += len(body)
                    if size >= limit:
                        yield flush()
        if held:
            yield flush()

    return released(run)


def inside(size: int, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Which bytes of a block's data are of pieces, not of what stands before them."""
    starts = np.cumsum(sizes + depth) - sizes
    steps = np.zeros(size + 1, np.int8)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes, -1)
    return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


def strings(data: np.ndarray, own: np.ndarray, depth: int) -> np.ndarray:
    """The depth + 1 bytes that end at each byte of the pieces, as one number each."""
    out = data.astype(np.int64)
    for k in range(1, depth + 1):
        out[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return out[own]


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by part, and where each part ends in it."""
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    part = (mixed % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))


def words_in(data: np.ndarray, own: np.ndarray, sizes: np.ndarray, depth: int) -> pa.Array:
    """All words of a block, in order."""
    starts = np.cumsum(sizes + depth) - sizes
    stop = np.flatnonzero((data == 32) & own)
    # a word begins where a piece does or behind the space before it
    first = starts[np.searchsorted(starts, stop, side="right") - 1]
    begin = np.maximum(first, np.concatenate([[0], stop[:-1] + 1])) if len(stop) else stop
    offsets = np.zeros(2 * len(stop) + 1, np.int32)
    offsets[:-1:2], offsets[1::2], offsets[-1] = begin, stop, len(data)
    # every second value of this array is a word
    gaps = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(stop), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return gaps.take(pa.array(np.arange(0, 2 * len(stop), 2)))


def coded(values: pa.Array, learn: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, which of them each value is, and how many of each are learnt from."""
    found = values.dictionary_encode()
    place = found.indices.to_numpy(zero_copy_only=False)
    return found.dictionary, place, np.bincount(place[learn], minlength=len(found.dictionary))


def distinct(row: dict, depth: int, parts: int):
    """Of a block: strings with their places, training counts, and order by part; words likewise."""
    text = pa.decompress(row["data"], decompressed_size=row["raw"], codec="zstd", asbytes=True)
    data, sizes = np.frombuffer(text, np.uint8), np.asarray(row["sizes"], np.int64)
    train, own = np.asarray([bool(x) for x in row["train"]]), inside(len(data), sizes, depth)
    keys, place, n = coded(pa.array(strings(data, own, depth)), np.repeat(train, sizes))
    keys = keys.to_numpy()
    words, at, m = coded(words_in(data, own, sizes, depth), np.repeat(train, np.asarray(row["tokens"], np.int64)))
    words = words.to_pylist()
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return (keys, place, n, *dealt(keys, parts)), (words, at, m, *dealt(hashes, parts))


REQUESTS = "kind string, part long, block long, keys binary, counts binary"


def to_requests(depth: int, parts: int):
    """Rows of BLOCKS to rows of REQUESTS: strings as their bytes behind their length, words between spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (keys, _, n, order, ends), (words, _, m, worder, wends) = distinct(row, depth, parts)
                out: list[tuple] = []
                for p in range(parts):
                    own = order[ends[p - 1] if p else 0 : ends[p]]
                    if len(own):
                        out.append(("s", p, row["block"], bytes([depth + 1]) + packed(keys[own], depth + 1), n[own].astype(np.int64).tobytes()))
                    own = worder[wends[p - 1] if p else 0 : wends[p]]
                    if len(own):
                        out.append(("w", p, row["block"], b" ".join([words[i] for i in own]), m[own].astype(np.int64).tobytes()))
                cols = list(zip(*out, strict=True)) or [()] * 5
                types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "part", "block", "keys", "counts"])

    return released(run)


def numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def packed(keys: np.ndarray, size: int) -> bytes:
    """The ``size`` low bytes of each number."""
    return keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers of as many bytes as each row's ``size`` says; rows: (size, bytes)."""
    out = []
    for x in column.to_pylist():
        size, raw = x[0], np.frombuffer(x, np.uint8, offset=1)
        wide = np.zeros((len(raw) // size, 8), np.uint8)
        wide[:, :size] = raw.reshape(-1, size)
        out.append(wide.view("<i8").ravel())
    return out


def sum_strings(table: pa.Table) -> pa.Table:
    """A part's requests to its distinct strings and their counts."""
    found = pa.array(np.concatenate(unpacked(table["keys"]))).dictionary_encode()
    keys, place = found.dictionary.to_numpy(), found.indices.to_numpy()
    n = np.bincount(place, np.concatenate(numbers(table["counts"])), len(keys)).astype(np.int64)
    return pa.table({"part": pa.array(np.full(len(keys), table["part"][0].as_py())), "key": pa.array(keys), "n": pa.array(n)})


def answer_strings(table: pa.Table, known: pa.Table) -> pa.Table:
    """A part's requests and its strings' probabilities to answers in the order of the requests."""
    order = np.argsort(known["key"].to_numpy())
    keys, bits = known["key"].to_numpy()[order], known["bits"].to_numpy()[order]
    found = [bits[np.searchsorted(keys, k)].tobytes() for k in unpacked(table["keys"])]
    return pa.table({"kind": table["kind"], "part": table["part"], "block": table["block"], "values": pa.array(found, pa.binary()), "known": pa.array([0] * len(found), pa.int64())})


def answer_words(table: pa.Table) -> pa.Table:
    """A part's words to their counts in the order of the requests; ``known`` of the first
    row is the number of distinct words that training texts hold."""
    asked = [k.split(b" ") for k in table["keys"].to_pylist()]
    found = pa.array([w for a in asked for w in a], pa.binary()).dictionary_encode()
    place = found.indices.to_numpy(zero_copy_only=False)
    n = np.bincount(place, np.concatenate(numbers(table["counts"])), len(found.dictionary)).astype(np.int64)
    values = [x.tobytes() for x in np.split(n[place], np.cumsum([len(a) for a in asked])[:-1])]
    known = [int((n > 0).sum())] + [0] * (len(values) - 1)
    return pa.table({"kind": table["kind"], "part": table["part"], "block": table["block"], "values": pa.array(values, pa.binary()), "known": pa.array(known, pa.int64())})


ANSWERS = "kind string, part long, block long, values binary, known long"

# ---- the weighted trees -----------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series behind eight steps."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * log_gamma(np.array([0.5])) - log_gamma(zeros + ones + 1.0)


def up(zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the weighted probability, and the weight of the own estimate in the next
    bit's; ``longer``: logarithm of the product over the longer contexts, None at full depth."""
    own = log_kt(zeros, ones)
    if longer is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, longer) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, where each row is among them, and the sums of the values."""
    found, place = np.unique(keys, return_inverse=True)
    return found, place, *[np.bincount(place, v, len(found)) for v in values]


def levels(keys: np.ndarray, n: np.ndarray, depth: int, least: int):
    """Of strings with counts: per context length, from ``depth`` down to ``least``, the keys
    (context << 8 | decision), counts, weights, and each key's place one level down; also
    the places of a string's eight decisions, its bits, and the last weighted logarithms."""
    byte, context = keys & 255, keys >> 8
    steps = np.arange(8)
    node = (1 << steps) | (byte[:, None] >> (8 - steps))
    bit = (byte[:, None] >> (7 - steps)) & 1
    full = ((context[:, None] << 8) | node).ravel()
    times = np.repeat(n, 8).astype(float)
    at, place, zeros, ones = summed(full, times * (bit.ravel() == 0), times * (bit.ravel() == 1))
    logs, weight = up(zeros, ones, None)
    out = [(at, zeros, ones, weight, None)]
    for length in range(depth - 1, least - 1, -1):
        at, down, zeros, ones, longer = summed(at & ((1 << 8 * (length + 1)) - 1), zeros, ones, logs)
        logs, weight = up(zeros, ones, longer)
        out.append((at, zeros, ones, weight, down))
    return out, place.reshape(-1, 8), bit, logs


def trees_up(depth: int):
    """Strings of whole groups to what contexts of one byte need: ``key, zeros, ones, logs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int64()), ("n", pa.int64())]))
        if table.num_rows:
            found, _, _, logs = levels(table["key"].to_numpy(), table["n"].to_numpy(), depth, 2)
            at, zeros, ones, _, _ = found[-1]
            key, _, zeros, ones, logs = summed(at & 0xFFFF, zeros, ones, logs)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(zeros), pa.array(ones), pa.array(logs)], names=["key", "zeros", "ones", "logs"])

    return released(run)


def trunk(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of one byte: what shorter contexts and they add to the chance of a one,
    and the share that is left to longer contexts.  Indexed by context << 8 | decision."""
    both, weight = up(zeros, ones, logs)
    _, place, z0, o0, l0 = summed(key & 255, zeros, ones, both)
    _, w0 = up(z0, o0, l0)
    add0, left0 = w0 * (o0 + 0.5) / (z0 + o0 + 1), 1 - w0
    add, left = np.zeros(1 << 16), np.ones(1 << 16)
    add[key] = add0[place] + left0[place] * weight * (ones + 0.5) / (zeros + ones + 1)
    left[key] = left0[place] * (1 - weight)
    return add, left


def trees_down(depth: int, base: tuple[np.ndarray, np.ndarray]):
    """Strings of whole groups to their last byte's logarithm (base 2) of probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("part", pa.int64())]))
        if not table.num_rows:
            return
        found, place, bit, _ = levels(table["key"].to_numpy(), table["n"].to_numpy(), depth, 2)
        at, zeros, ones, weight, _ = found[-1]
        add, left = base[0][at & 0xFFFF], base[1][at & 0xFFFF]
        for i in range(len(found) - 1, -1, -1):
            at, zeros, ones, weight, _ = found[i]
            add, left = add + left * weight * (ones + 0.5) / (zeros + ones + 1), left * (1 - weight)
            if i:
                down = found[i][4]
                add, left = add[down], left[down]
        chance = np.where(bit == 1, add[place], 1 - add[place])
        bits = np.log2(np.maximum(chance, 1e-300)).sum(1)
        yield pa.RecordBatch.from_arrays([table["part"].combine_chunks(), table["key"].combine_chunks(), pa.array(bits)], names=["part", "key", "bits"])

    return released(run)


# ---- scores -----------------------------------------------------------------------------

SCORED = "row long, doc_id long, n_tokens long, n_known long, logs double, bits double, n_bytes long, ended boolean"


def scored(depth: int, parts: int):
    """A block and its answers to sums by piece: words known, their log10 (count + 1), bits."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        (keys, place, _, order, _), (words, at, _, worder, _) = distinct(row, depth, parts)
        got = {(k, p): v for k, p, v in zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), answers["values"].to_pylist(), strict=True)}
        back = lambda kind, order, of: (np.frombuffer(b"".join(got[kind, p] for p in range(parts) if (kind, p) in got), of), order)
        bits, counts = np.empty(len(keys)), np.empty(len(words), np.int64)
        for held, (values, where) in ((bits, back("s", order, np.float64)), (counts, back("w", worder, np.int64))):
            held[where] = values
        sizes, tokens = np.asarray(row["sizes"], np.int64), np.asarray(row["tokens"], np.int64)
        piece = np.arange(len(sizes))
        # a block without words has integer sums otherwise
        by = lambda values, lengths: np.bincount(np.repeat(piece, lengths), values, len(piece)).astype(float)
        c = counts[at]
        return pa.table({
            "row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(tokens),
            "n_known": pa.array(by(c > 0, tokens).astype(np.int64)), "logs": pa.array(by(np.log10(c + 1), tokens)), "bits": pa.array(by(bits[place], sizes)),
            "n_bytes": pa.array(sizes), "ended": pa.array(row["ends"], pa.bool_()),
        })

    return run


def score(docs: DataFrame, depth: int = 4, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, part: int = PART, additive: bool = False) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``base_score`` takes a token seen c times among N, V of them distinct, as likely as
    (c + 1) / ((N + 1) * (V + 1)), with ``additive`` as (c + 1) / (N + V + 1).

    Texts whose id's crc32 leaves another remainder than ``fold`` are learnt from.  Null
    texts are empty: one token, the end.  Rows without an id are scored, are in no fold and
    aren't learnt from.  Repeated rows count and are scored each.  Without any training
    text every decision has even chances.  A text longer than a block is cut between words
    and summed again.  Other columns are ignored; an empty table gives no rows.
    ``depth`` is 2 to 6.
    """
    spark = small_batches(docs.sparkSession)
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(rest != fold, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    blocks = cut(rows.mapInArrow(to_blocks(depth, block), BLOCKS))
    size, train_ends, train_words = blocks.select(
        F.sum("raw"), F.sum(F.size(F.filter(F.arrays_zip("train", "ends"), lambda x: x["train"] & x["ends"]))),
        F.sum(F.aggregate(F.arrays_zip("train", "tokens"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["train"], x["tokens"]).otherwise(0))),
    ).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // part))
    requests = cut(blocks.mapInArrow(to_requests(depth, parts), REQUESTS))
    asked, words = requests.where("kind = 's'"), requests.where("kind = 'w'")

    counts = cut(asked.groupBy("part").applyInArrow(sum_strings, "part long, key long, n long"))
    near = F.col("key").bitwiseAND(F.lit(0xFFFF00))  # the two bytes before the last
    grouped = counts.withColumn("near", near).repartition(parts, "near")
    low = grouped.select("key", "n").mapInArrow(trees_up(depth), "key long, zeros double, ones double, logs double")
    low = low.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "logs")]).toArrow()  # at most 65,280 rows
    base = trunk(*[low[c].to_numpy() for c in ("key", "zeros", "ones", "logs")])
    model = grouped.select("key", "n", "part").mapInArrow(trees_down(depth, base), "part long, key long, bits double")
    answers = asked.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(answer_strings, ANSWERS)
    answers = cut(answers.unionByName(words.groupBy("part").applyInArrow(answer_words, ANSWERS)))

    total = (train_ends or 0) + (train_words or 0)
    distinct_ = (answers.agg(F.sum("known")).first()[0] or 0) + bool(train_ends)
    pieces = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored(depth, parts), SCORED)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "bits", "n_bytes")]
    docs_ = pieces.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), *sums)
    own = F.lit(float(np.log10((train_ends or 0) + 1)))
    below = np.log10(total + distinct_ + 1) if additive else np.log10(total + 1) + np.log10(distinct_ + 1)
    tokens = F.col("n_tokens") + 1
    return docs_.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out"), tokens.alias("n_tokens"),
        (F.col("n_known") + int(bool(train_ends))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + own - tokens * F.lit(float(below))).alias("base_score"),
        (F.col("bits") * float(np.log10(2))).alias("score"), (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
