"""Audio features of byte payloads (operator 3).

A text's bytes, padded with blanks to a multiple of 192, become the samples of an 8-bit
PCM WAV.  The stored file is read back; its samples are resampled by 2/3 with a
polyphase filter, framed with 50 % overlap into a log-mel filterbank, and cut into
energetic segments by two thresholds (hysteresis).  The filterbank is stored as an Arrow
stream of fixed-shape tensors with the time span of each.  One narrow pass, no shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import released, small_batches, utf8

UNIT = 192
RATE = 8000  # samples a second of the stored form
UP, DOWN = 2, 3
FRAME, HOP, MELS = 128, 64, 16
SHAPE = (16, MELS)  # frames and bands of a tensor
TAPS = 12  # of each phase
BLOCK = 1 << 14  # frames transformed at once
OPEN_DB, CLOSE_DB = 1.0, -1.0  # about the mean energy


def pack(raw: bytes) -> bytes:
    return raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def to_wav(payload: bytes) -> bytes:
    """An 8-bit mono PCM file; the payload's length is even, so no pad byte follows."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(taps of the even outputs, of the odd ones, window, filterbank)."""
    n = UP * TAPS
    k = np.arange(n) - (n - 1) / 2
    low = np.sinc(k / DOWN) * np.hamming(n)
    low *= UP / low.sum()
    bins = np.arange(FRAME // 2 + 1) * (RATE * UP / DOWN) / FRAME
    mel = 2595 * np.log10(1 + bins / 700)
    edges = np.linspace(0, mel[-1], MELS + 2)
    up = (mel[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - mel[:, None]) / (edges[2:] - edges[1:-1])
    return low[0::2][::-1].copy(), low[1::2][::-1].copy(), np.hanning(FRAME), np.clip(np.minimum(up, down), 0, None)


def resample(x: np.ndarray) -> np.ndarray:
    """By 2/3: each output is one phase of the filter over the samples, none is computed in vain."""
    even, odd, _, _ = tables()
    padded = np.concatenate([np.zeros(TAPS - 1), x, np.zeros(1)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(len(x) // DOWN * UP)
    out[0::2] = seen[: len(x) : DOWN] @ even
    out[1::2] = seen[1 : len(x) + 1 : DOWN] @ odd
    return out


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log filterbank in dB, log energy in dB) of each frame."""
    _, _, window, bank = tables()
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mel, energy = [], []
    for at in range(0, len(frames), BLOCK):
        part = frames[at : at + BLOCK] * window
        power = np.abs(np.fft.rfft(part, axis=1)) ** 2
        mel.append(10 * np.log10(power @ bank + 1e-10))
        energy.append(10 * np.log10((part**2).mean(axis=1) + 1e-10))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [from, to) of each segment: it opens above the upper threshold and closes below the lower one."""
    level = energy - energy.mean()
    last = np.maximum.accumulate(np.where((level > OPEN_DB) | (level < CLOSE_DB), np.arange(len(level)), -1))
    active = (last >= 0) & (level[np.maximum(last, 0)] > OPEN_DB)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def tensor_stream(mel: np.ndarray) -> bytes:
    """An Arrow stream: start and end in seconds and a float32 tensor of ``SHAPE``; the last is filled up with zeros."""
    n = -(-len(mel) // SHAPE[0])
    full = np.zeros((n * SHAPE[0], MELS), np.float32)
    full[: len(mel)] = np.round(mel, 3)
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), SHAPE[0] * MELS)
    step = HOP / (RATE * UP / DOWN)
    start = np.arange(n) * SHAPE[0] * step
    stop = (np.minimum(np.arange(1, n + 1) * SHAPE[0], len(mel)) - 1) * step + FRAME / (RATE * UP / DOWN)
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(stop), pa.ExtensionArray.from_storage(kind, storage)], ["start_s", "stop_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def describe(raw: bytes) -> tuple:
    media = to_wav(pack(raw))
    payload = from_wav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mel, energy = log_mel(resample(x))
    found = segments(energy)
    tail = payload[-16:]
    return (
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(),
        len(mel), [a for a, _ in found], [b for _, b in found], tensor_stream(mel),
    )


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "n_frames int, seg_from array<int>, seg_to array<int>, tensors binary"
)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: the stored form's digests, segments and tensors.

    A null text counts as empty and has one unit of blanks; equal texts give equal values;
    a null id stays null; other columns are ignored.  Long texts are transformed in blocks.
    """

    def run(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [describe(t.as_py()) for t in part.column(1)]
                cols = [part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text")).mapInArrow(released(run), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns; ``feature`` says frames, segments, active frames and the tensors' digest."""
    active = F.aggregate(F.zip_with("seg_from", "seg_to", lambda a, b: b - a), F.lit(0), lambda s, n: s + n)
    feature = F.concat_ws(":", F.lit("logmel16x16"), F.col("n_frames"), F.size("seg_from"), active, F.substring(F.sha2("tensors", 256), 1, 32))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
