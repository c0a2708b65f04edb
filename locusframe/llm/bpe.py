"""Byte-level BPE encoding and decoding (operator 2).

One narrow stage, no shuffle.  A scan task splits its texts, keeps the distinct words
of a batch, and hands them to the JVM, where Spark higher-order functions fold the
ranked merges over each word's bytes with a constant table of ranks and concatenate the
binary pieces back.  The last step of the same task spells every text out of its words.

The rank map is a constant of two arrays: ``shift`` by left piece and ``pairs``, where
``pairs[shift[l] + r]`` holds ``(l + 1) << 17 | rank`` if pieces l and r join into a piece
of that rank, else 0 or another l's entry.  XOR with ``(l + 1) << 17`` leaves the rank, or
2**17 at least for no merge.

The fold of a word merges one pair a round and keeps the ranks of its pairs, of which a
merge changes two.  Those to start with are looked up by pairs of bytes, for all words of a
batch at once, where the words are split.  For long words a round merges every pair of the lowest rank at once,
from the left.  That equals merging them one by one: a pair that appears later has a
higher rank, because each piece is what its own merges give (checked when the ranks are
read).  So the rounds of a long word follow its distinct merges.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import cut, gathered, released, small_batches, tidy

#: Bytes of text whose words are kept distinct together, and of those split at once.
BATCH_BYTES, PIECE = 6 << 20, 1 << 19
#: Words folded once and handed to all tasks: the commonest of a sample.  Both bounds are
#: fixed, so the broadcast stays under about 16 MB at any input; it saves work and
#: changes no result, as every other word is folded where it occurs.
HOT_WORDS, HOT_SAMPLE = 1 << 18, 20_000
SLOTS = 3 << 17  # more where the rows of a rank map find no place
NONE = 1 << 17  # rank of a pair that doesn't merge, at least
ID_BITS = 20
ID, LAST = 1 << ID_BITS, 1 << 60  # LAST: entry of a word's last piece, less its own rank
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The endings that the public pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if any(merges(piece, ranks) != [rank] for piece, rank in ranks.items()):
        raise ValueError(f"{path}: a piece isn't what its own merges give")
    return ranks


def place(rows: dict[int, list[tuple[int, int]]], size: int, slots: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(shift by left piece, pairs), the longest rows first; None if a row finds no place."""
    room = slots - size
    if room <= 0:
        return None
    taken = np.zeros(slots, bool)
    table = np.zeros(slots, np.int64)
    shift = np.zeros(size, np.int64)
    rng = np.random.default_rng(0)
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        right = np.array([r for r, _ in row], np.int64)
        tries = rng.integers(0, room, 64)
        tries = tries[~taken[tries[:, None] + right].any(axis=1)]
        if not len(tries):  # look at every place
            tries = np.arange(room)
            for r in right.tolist():
                tries = tries[~taken[tries + r]]
            if not len(tries):
                return None
        at = shift[left] = tries[0]
        taken[at + right] = True
        table[at + right] = left + 1 << 17 | np.array([k for _, k in row], np.int64)
    return shift, table


@functools.lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """(rank of each single byte, shift by left piece, pairs, pieces by rank)."""
    ranks = load_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    size = max(ranks.values()) + 1
    slots = SLOTS
    while (placed := place(rows, size, slots)) is None:
        slots *= 2
    shift, table = placed
    pieces = [b""] * size
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return [ranks[bytes([b])] for b in range(256)], shift.astype(np.int32), table, pieces


@functools.lru_cache(maxsize=4)
def first_entries(path: str) -> np.ndarray:
    """The fold's entry of a byte by the next one, 256 for none."""
    single, shift, pairs, _ = pair_table(path)
    left = np.array(single, np.int64)[:, None]
    entries = (pairs[shift[left] + left.T] ^ (left + 1) * NONE) * ID + left
    return np.hstack([entries, LAST + left])


def constant(name: str, path: str) -> Column:
    """A table of the rank map as a constant: a scalar subquery over its one row, so that plans
    and what is told of them hold its name, not its half a million numbers."""
    _, shift, pairs, _ = pair_table(path)
    value = {"shift": (shift, pa.int32()), "pairs": (pairs, pa.int64())}[name]
    row = pa.table({name: pa.array([value[0]], pa.list_(value[1]))})
    return SparkSession.active().createDataFrame(row).select(name).scalar()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: Words up to so many bytes are folded a merge at a time, with the ranks of their pairs at
#: hand; longer ones by all merges of a rank at once, so that rounds don't grow with length.
STEPWISE = 64


def with_constants(df: DataFrame, path: str, *names: str) -> DataFrame:
    """Add tables of the rank map as columns ``_name``; the optimiser puts them where they are used."""
    return df.select("*", *[constant(n, path).alias(f"_{n}") for n in names])


def encode_word(state: Column) -> Column:
    """Ranks of a word, given the state to start with as ``array<bigint>``, with the constants
    ``_pairs`` and ``_shift``."""

    def fold(pairs: Column, shifts: Column) -> Column:
        return F.when(F.size(state) <= STEPWISE, stepwise(state, pairs, shifts)).otherwise(by_rank(F.transform(state, piece), pairs, shifts))

    # each constant is used once, else it would be copied from row to row
    return let(F.col("_pairs"), lambda pairs: let(F.col("_shift"), lambda shifts: fold(pairs, shifts)))


def piece(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(ID - 1).cast("bigint")).cast("int")


def rank_of(left: Column, right: Column, pairs: Column, shifts: Column) -> Column:
    return pairs[shifts[left] + right].bitwiseXOR((left + F.lit(1).cast("bigint")) * NONE)


def pair_ranks(ids: Column, pairs: Column, shifts: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda j: rank_of(ids[j], ids[j + 1], pairs, shifts))


def stepwise(state: Column, pairs: Column, shifts: Column) -> Column:
    """The fold with the lowest rank's first pair merged in each step.

    The state is one number a piece: the rank of its pair with the next one, times ID, plus
    its own.  The least number is the next merge, and a merge changes two of them.
    """
    entry = lambda left, right: F.when(right.isNull(), F.lit(LAST)).otherwise(rank_of(left, right, pairs, shifts) * ID) + left

    def merged(s: Column, at: Column, new: Column) -> Column:
        own = F.array(entry(new, piece(F.get(s, at + 1))))
        before = let(piece(F.get(s, at - 2)), lambda left: F.array(entry(left, new)))
        tail = F.slice(s, at + 2, F.size(s))
        return F.when(at == 1, F.concat(own, tail)).otherwise(F.concat(F.slice(s, F.lit(1), at - 2), before, own, tail))

    def step(s: Column, _: Column) -> Column:
        return let(F.array_min(s), lambda low: F.when(low >= NONE * ID, s).otherwise(let(F.array_position(s, low).cast("int"), lambda at: merged(s, at, F.shiftright(low, ID_BITS).cast("int")))))

    return F.aggregate(F.sequence(F.lit(2), F.size(state)), state, step, lambda s: F.transform(s, piece))


def by_rank(first: Column, pairs: Column, shifts: Column) -> Column:
    """The fold with all pairs of the lowest rank merged in each step, from the left; an
    element -1 marks a word that is done."""

    def merged(ids: Column, is_left: Callable[[Column], Column], rank: Column) -> Column:
        out = F.transform(ids, lambda x, j: F.when(is_left(j), rank.cast("int")).when(is_left(j - 1), F.lit(-1)).otherwise(x))
        return F.filter(out, lambda x: x >= 0)

    def all_merged(ids: Column, ranks: Column, rank: Column) -> Column:
        # of pairs that overlap the first merges, and every second one after it
        hits = F.array_join(F.transform(ranks, lambda r: F.when(r == rank, "1").otherwise("0")), "")
        marks = F.split(F.regexp_replace(hits, "11", "12"), "")
        return let(marks, lambda m: merged(ids, lambda j: (j >= 0) & (F.get(m, j) == "1"), rank))

    def step(ids: Column, _: Column) -> Column:
        done = (F.size(ids) < 2) | (F.element_at(ids, -1) < 0)
        joined = lambda r, m: F.when(m >= NONE, F.concat(ids, F.array(F.lit(-1)))).otherwise(all_merged(ids, r, m))
        return F.when(done, ids).otherwise(let(pair_ranks(ids, pairs, shifts), lambda r: let(F.array_min(r), lambda m: joined(r, m))))

    return F.aggregate(F.sequence(F.lit(2), F.size(first)), first, step, lambda ids: F.filter(ids, lambda x: x >= 0))


def decode_word(ids: Column, path: str) -> Column:
    """Bytes of a word: its binary pieces, concatenated.  The pieces are a literal, parsed once."""
    text = json.dumps([base64.b64encode(x).decode() for x in pair_table(path)[3]], separators=(",", ":"))
    return let(F.from_json(F.lit(text), "array<binary>"), lambda pieces: F.aggregate(ids, F.lit(b""), lambda out, i: F.concat(out, pieces[i])))


def merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of a word by single merges: lowest rank first, leftmost among equals."""
    n = len(word)
    start, after, before = list(range(n)), [*range(1, n), -1], list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := ranks.get(word[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or end[j] != stop:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


@functools.lru_cache(maxsize=1)
def class_runs() -> tuple[bytes, bytes]:
    """(first code point, class) of each run of one class, as the tokenizer's own matching has them."""
    kind = np.full(0x110000, OTHER, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        enc = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for at in range(0, 0x110000, 0x4000):  # a part at a time, without the surrogates
            points = np.arange(at, at + 0x4000, dtype=np.uint32)
            text = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")
            kind[np.frombuffer(bytes(enc.encode_ordinary(text)).decode().encode("utf-32-le"), np.uint32)] = value
    new = np.flatnonzero(np.diff(kind, prepend=0))
    return new.astype(np.int32).tobytes(), kind[new].tobytes()


@functools.lru_cache(maxsize=1)
def classes(runs: tuple[bytes, bytes]) -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    first = np.frombuffer(runs[0], np.int32)
    return np.repeat(np.frombuffer(runs[1], np.uint8), np.diff(first, append=0x110000))


def word_starts(code: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the public pattern's matches begin, over texts laid end to end.

    ``code``: code points; ``first``: true at the first of each text; ``kinds``: ``classes``.
    """
    n = len(code)
    kind = kinds[code]
    run = np.empty(n, bool)  # a run of one class begins
    run[:1] = True
    run[1:] = kind[1:] != kind[:-1]
    run |= first
    starts = run.copy()
    space = kind == SPACE
    ends = np.empty(n, bool)  # the last of a run
    ends[:-1] = run[1:]
    ends[-1:] = True
    inner = np.zeros(n, bool)  # the last of a run of white space that has a word after it in the text
    inner[:-1] = space[:-1] & ends[:-1] & ~first[1:]
    starts |= inner
    blank = np.flatnonzero(inner & (code == 32))
    starts[blank + 1] = False  # the word takes the blank before it
    mark = np.flatnonzero(run & ends & (code == 39))  # an apostrophe alone
    mark = mark[starts[mark]]  # not taken by a blank
    heads = np.flatnonzero(first)
    letter = kind == LETTER
    for tail in CONTRACTIONS:
        at = mark[mark + len(tail) < n]
        ok = np.ones(len(at), bool)
        for k, c in enumerate(tail, 1):
            ok &= code[at + k] == ord(c)
        at = at[ok]
        at = at[np.searchsorted(heads, at, "right") == np.searchsorted(heads, at + len(tail), "right")]
        starts[at + 1] = False
        after = at + 1 + len(tail)
        after = after[after < n]
        starts[after[letter[after] & ~first[after]]] = True
    return starts


def hashed(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each slice; among 10**6 words two share a key with a chance of 3 in 10**8."""
    raw = np.frombuffer(joined, np.uint8)
    out = (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    short = end - begin <= 32
    rows = np.flatnonzero(short)
    width = int((end - begin)[rows].max(initial=0))
    for k in range(width):
        rows = rows[begin[rows] + k < end[rows]]
        x = out[rows] ^ raw[begin[rows] + k].astype(np.uint64)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[rows] = x ^ (x >> np.uint64(32))
    for i in np.flatnonzero(~short):
        out[i] = int.from_bytes(hashlib.blake2b(joined[begin[i] : end[i]], digest_size=8).digest(), "little")
    return out


def split_batch(raws: list[bytes], kinds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their keys, index of each word, words per text)."""
    ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(raws)]
    parts = [split_piece(raws[a:b], kinds) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys, some, index = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
    words = [w for p in parts for w in p[0]]
    base = np.cumsum([0, *[len(p[0]) for p in parts]])
    return [words[i] for i in some.tolist()], keys, np.concatenate([index[p[2] + b] for p, b in zip(parts, base, strict=False)]).astype(np.int32), np.concatenate([p[3] for p in parts])


def split_piece(raws: list[bytes], kinds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    joined = b"".join(raws)
    text = joined.decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(joined, np.uint8)
    lead = (raw & 0xC0) != 0x80
    sizes = np.array([len(r) for r in raws], np.int64)
    offsets = np.cumsum(sizes) - sizes
    byte_at = np.flatnonzero(lead)
    if len(byte_at) != len(code):  # not UTF-8: no such text comes out of Spark's strings
        raise ValueError("texts are not valid UTF-8")
    first = np.zeros(len(code), bool)
    first[np.searchsorted(byte_at, offsets[sizes > 0])] = True
    begin = byte_at[np.flatnonzero(word_starts(code, first, kinds))]
    end = np.append(begin[1:], len(raw))[: len(begin)]
    counts = np.searchsorted(begin, offsets + sizes) - np.searchsorted(begin, offsets)
    keys, some, index = np.unique(hashed(joined, begin, end), return_index=True, return_inverse=True)
    words = [joined[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
    return words, keys, index, counts


def start_states(words: list[bytes], first: np.ndarray, mask: np.ndarray) -> pa.Array:
    """The state that the fold of each word starts with; null where ``mask``."""
    sizes = np.array([0 if m else len(w) for w, m in zip(words, mask, strict=True)], np.int64)
    raw = np.frombuffer(b"".join(w for w, m in zip(words, mask, strict=True) if not m), np.uint8)
    off = np.concatenate([[0], np.cumsum(sizes)])
    right = np.append(raw[1:].astype(np.int64), 256)[: len(raw)]
    right[off[1:][sizes > 0] - 1] = 256
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(first[raw, right]), mask=pa.array(mask))


def hot_words(docs: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, offsets, ids) of the commonest words of a sample, folded."""
    first, limit, runs = first_entries(path), BATCH_BYTES, class_runs()
    rows = docs.count()
    some = docs.sample(fraction=HOT_SAMPLE / rows, seed=2) if rows > HOT_SAMPLE else docs

    def count(batches):
        for table in gathered(batches, "text", limit):
            words, _, index, _ = split_batch(table.column("text").to_pylist(), classes(runs))
            n = np.bincount(index, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    def states(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), start_states(words, first, np.zeros(len(words), bool))], ["word", "state"])

    words = some.mapInArrow(released(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 2")
    # written first: the plan with the rank table has no exchange, so it is made once
    words = cut(words.orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word").repartition(16))
    begun = words.mapInArrow(released(states), "word binary, state array<long>")
    got = with_constants(begun, path, "pairs", "shift").select("word", encode_word(F.col("state")).alias("ids")).toArrow()
    tidy(docs.sparkSession, words)
    keys = [np.zeros(0, np.uint64)]
    for part in got.column("word").chunks:  # a part at a time: the driver needs the keys only
        names = part.to_pylist()
        end = np.cumsum([len(w) for w in names], dtype=np.int64)
        keys.append(hashed(b"".join(names), np.concatenate([[0], end])[:-1].astype(np.int64), end))
    keys, ids = np.concatenate(keys), got.column("ids").combine_chunks()
    order = np.argsort(keys)
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    begin, n = offsets[:-1][order], np.diff(offsets)[order]
    off = np.concatenate([[0], np.cumsum(n)])
    flat = values[np.arange(int(off[-1])) + np.repeat(begin - off[:-1], n)] if len(keys) else np.zeros(0, np.int32)
    return keys[order], off, flat.astype(np.int32)


SPLIT = "doc long, word binary, ids array<int>, state array<long>"


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes``.  Null texts count
    as empty (no tokens); repeated rows and repeated ids give a row each; a null id stays
    null; other columns of ``docs`` are ignored, so their names can't clash.  Nothing is
    cut, and words of any length are folded alike.  Equal words of a batch are told by a
    64-bit hash.  Letters, numbers and white space are those of the tokenizer's own patterns.
    """
    first, limit, runs = first_entries(path), BATCH_BYTES, class_runs()
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    spark = small_batches(docs.sparkSession)
    tidy(spark)
    shared = spark.sparkContext.broadcast(hot_words(source.select("text"), path))
    tidy(spark)

    def split(batches):
        hot, hot_off, hot_ids = shared.value
        for table in gathered(batches, "text", limit):
            raws = table.column("text").to_pylist()
            words, keys, index, counts = split_batch(raws, classes(runs))
            at_hot = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
            is_hot = hot[at_hot] == keys if len(hot) else np.zeros(len(keys), bool)
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                known, where = is_hot[at : at + 20_000], at_hot[at : at + 20_000]
                done = [hot_ids[hot_off[i] : hot_off[i + 1]] if h else None for h, i in zip(known.tolist(), where.tolist(), strict=True)]
                states = start_states(some, first, known)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(some), pa.int64()), pa.array(some, pa.binary()), pa.array(done, pa.list_(pa.int32())), states],
                    ["doc", "word", "ids", "state"],
                )
            off = np.concatenate([[0], np.cumsum(counts)])
            docs_col = table.column("doc").combine_chunks()
            for at in range(0, len(raws), 2_000):
                to = min(at + 2_000, len(raws))
                part = pa.ListArray.from_arrays(pa.array(off[at : to + 1] - off[at], pa.int32()), pa.array(index[off[at] : off[to]]))
                n = to - at
                # an empty word array marks a text; `ids` carries its word numbers
                yield pa.RecordBatch.from_arrays(
                    [docs_col.slice(at, n), pa.nulls(n, pa.binary()), part, pa.nulls(n, pa.list_(pa.int64()))], ["doc", "word", "ids", "state"]
                )

    def spell(batches):
        text: list[bytes] = []
        spelled: list[bytes] = []
        lengths: list[np.ndarray] = []
        open_words = True
        sizes = np.zeros(0, np.int64)
        for batch in batches:
            is_word = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(is_word.astype(np.int8))) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                ids = part.column(2)
                off = ids.offsets.to_numpy()
                values = ids.values.to_numpy()
                if is_word[a]:
                    if not open_words:
                        text, spelled, lengths, open_words = [], [], [], True
                    as_text = list(map(str, values[off[0] : off[-1]].tolist()))
                    o = (off - off[0]).tolist()
                    text += [" ".join(as_text[x:y]).encode() for x, y in zip(o[:-1], o[1:], strict=True)]
                    spelled += part.column(3).to_pylist()
                    lengths.append(np.diff(off))
                    continue
                if open_words:
                    sizes = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
                    open_words = False
                n, sha, back, bytes_ = [], [], [], []
                for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    which = values[x:y]
                    n.append(int(sizes[which].sum()))
                    which = which.tolist()
                    sha.append(hashlib.sha256(b" ".join([text[i] for i in which])).hexdigest())
                    whole = b"".join([spelled[i] for i in which])
                    back.append(hashlib.sha256(whole).hexdigest())
                    bytes_.append(len(whole))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(bytes_, pa.int64())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

    rows = source.mapInArrow(released(split), SPLIT)
    ids = F.coalesce(F.col("ids"), encode_word(F.col("state")))
    rows = with_constants(rows, path, "pairs", "shift").select("doc", "word", ids.alias("ids"))
    rows = rows.select("doc", "word", "ids", F.when(F.col("word").isNotNull(), decode_word(F.col("ids"), path)).alias("back"))
    return rows.mapInArrow(released(spell), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
