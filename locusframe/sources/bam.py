"""BAM files as a Spark data source, read in splits and written in parts.

A BAM file is a row of compressed blocks (BGZF), each of which tells its own length, and
alignment records that run on from block to block.  A file is dealt into byte ranges.  A
block belongs to the range in which it begins, and a record to the block in which it
begins.  A task finds the first block of its range by its magic bytes, its length and its
checksum, and the first record by trying places until a chain of plausible records
follows; it reads on beyond its range only to finish its last record.

Predicates on flags, mapping quality and contig are checked on the fixed part of a record,
before names, bases, qualities and tags are decoded.

Files are opened with Arrow's file systems, so a path may be local (a shared mount) or the
address of a store that Arrow knows.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, Not, WriterCommitMessage,
)
from pyspark.sql.types import StructType

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format.
FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "neg_strand": 16, "mate_neg_strand": 32, "first_of_pair": 64, "second_of_pair": 128, "not_primary": 256, "vendor_fail": 512, "duplicate": 1024}
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
ON_REFERENCE, ON_READ = "MDN=X", "MIS=X"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAGIC = b"\x1f\x8b\x08\x04"

SCHEMA = (
    "name string, contig string, start int, end int, mapq int, "
    + ", ".join(f"{k} boolean" for k in FLAGS)
    + ", cigar array<struct<op:string,len:int>>, mate_contig string, mate_start int, template_len int, bases string, quals array<int>, attrs map<string,string>, tag_types map<string,string>, read_group string"
)
COLUMNS = ["name", "contig", "start", "end", "mapq", *FLAGS, "cigar", "mate_contig", "mate_start", "template_len", "bases", "quals", "attrs", "tag_types", "read_group"]


# ---- files and blocks -------------------------------------------------------------------


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """BAM files at a path, which is one or a folder of them, and their sizes."""
    system, at = store(path)
    head = path[: len(path) - len(at)] if "://" in path else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(".bam")]
    elif info.type == fs.FileType.File:
        found = [info]
    else:
        raise FileNotFoundError(path)
    return sorted((head + f.path, f.size) for f in found)


def block_at(raw: bytes, at: int) -> int | None:
    """Length of the block that begins at a place of ``raw``; None if none does, -1 if raw ends before its header does."""
    if raw[at : at + 4] != MAGIC[: len(raw) - at]:
        return None
    if at + 18 > len(raw):
        return -1
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    place, stop = at + 12, at + 12 + extra
    if stop > len(raw):
        return -1
    while place + 4 <= stop:
        kind, size = raw[place : place + 2], struct.unpack_from("<H", raw, place + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", raw, place + 4)[0] + 1
        place += 4 + size
    return None


def inflated(block: bytes) -> bytes:
    extra = struct.unpack_from("<H", block, 10)[0]
    out = zlib.decompress(block[12 + extra : -8], -15)
    crc, size = struct.unpack_from("<II", block, len(block) - 8)
    if size != len(out) or crc != zlib.crc32(out):
        raise ValueError("damaged block")
    return out


def blocks(file, start: int, size: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and content of each block from the first that begins at or after ``start``."""
    at, raw, place, synced = start, b"", 0, start == 0
    while True:
        if len(raw) - place < 1 << 17 and at < size:
            file.seek(at)
            more = file.read(min(chunk, size - at))
            raw, place, at = raw[place:] + more, 0, at + len(more)
        base = at - len(raw)
        if place >= len(raw):
            return
        length = block_at(raw, place)
        whole = length is not None and 0 < length <= len(raw) - place
        try:
            content = inflated(raw[place : place + length]) if whole else None
        except (ValueError, zlib.error):
            content = None
        if content is None:
            if synced:
                raise ValueError(f"no block at {base + place}")
            found = raw.find(MAGIC, place + 1)
            place = found if found >= 0 else max(len(raw) - 3, place + 1)
            continue
        synced = True
        yield base + place, content
        place += length


def header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Text and references of a file."""
    system, at = store(path)
    with system.open_input_file(at) as file:
        data, parts = b"", blocks(file, 0, file.size())

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                data += next(parts)[1]

        need(12)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        size = struct.unpack_from("<i", data, 4)[0]
        need(12 + size)
        text = data[8 : 8 + size].rstrip(b"\0").decode()
        n, place, out = struct.unpack_from("<i", data, 8 + size)[0], 12 + size, []
        for _ in range(n):
            need(place + 4)
            length = struct.unpack_from("<i", data, place)[0]
            need(place + 8 + length)
            out.append((data[place + 4 : place + 3 + length].decode(), struct.unpack_from("<i", data, place + 4 + length)[0]))
            place += 8 + length
        return text, out


# ---- records ----------------------------------------------------------------------------

FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
HEAD = "<iiiBBHHHiiii"


def plausible(data: bytes, at: int, n_refs: int) -> int | None:
    """End of the record that may begin at a place; None if none can, -1 if data ends too early to tell."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, _, _, ops, flag, seq, mate_ref, mate_pos, _ = struct.unpack_from(HEAD, data, at)
    tags = size - (32 + name + 4 * ops + (seq + 1) // 2 + seq)
    if not (0 <= tags < (1 << 20) + 8 * seq and name > 0 and seq >= 0 and -1 <= ref < n_refs and -1 <= mate_ref < n_refs and pos >= -1 and mate_pos >= -1 and flag < 4096):
        return None
    stop = at + 36 + name
    label = data[at + 36 : stop]
    if len(label) == name and (label[-1] != 0 or any(not 33 <= c <= 126 for c in label[:-1])):
        return None
    if stop + 4 * ops <= len(data):
        cigar = np.frombuffer(data, "<u4", ops, stop)
        if (cigar & 15 > 8).any():
            return None
        on_read = int((cigar >> 4)[np.isin(cigar & 15, (0, 1, 4, 7, 8))].sum())
        if ops and seq and on_read != seq:
            return None
    return at + 4 + size


def first_record(data: bytes, n_refs: int, chain: int = 8) -> int | None:
    """The first place from which a chain of plausible records runs, to its end or to that of ``data``."""
    for at in range(len(data)):
        place, seen = at, 0
        while seen < chain:
            end = plausible(data, place, n_refs)
            if end is None or end == -1:
                break
            seen += 1
            place = end
            if place >= len(data):
                end = -1
                break
        if seen and (seen == chain or end == -1):
            return at
    return None


@dataclass
class Keep:
    """Which records are read: flags by name, least mapping quality, contigs."""

    flags: dict[str, bool] = field(default_factory=dict)
    least: int = 0
    contigs: list[str] | None = None

    def mask(self, fixed: np.ndarray, names: list[str]) -> np.ndarray:
        on = fixed["mapq"] >= self.least
        for k, v in self.flags.items():
            on &= ((fixed["flag"] & FLAGS[k]) != 0) == v
        if self.contigs is not None:
            wanted = [i for i, n in enumerate(names) if n in self.contigs] + ([-1] if "*" in self.contigs else [])
            on &= np.isin(fixed["ref"], wanted)
        return on


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


#: Whole numbers in tags, as numpy's types.
INTEGERS = {"c": "i1", "C": "u1", "s": "i2", "S": "u2", "i": "i4", "I": "u4"}


def one_tag(data: bytes, at: int) -> tuple[str, str, int]:
    """Type letter of the text form, value and end of a tag that is a letter, a fraction or a list."""
    codes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    say = lambda kind, x: f"{x:g}" if kind == "f" else str(x)
    kind, at = chr(data[at + 2]), at + 3
    if kind == "A":
        return kind, chr(data[at]), at + 1
    if kind == "f":
        return kind, say(kind, struct.unpack_from("<f", data, at)[0]), at + 4
    if kind != "B":
        raise ValueError(f"unknown type of tag: {kind}")
    sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
    values = struct.unpack_from(f"<{n}{codes[sub]}", data, at + 5)
    return kind, ",".join([sub, *[say(sub, x) for x in values]]), at + 5 + n * struct.calcsize(codes[sub])


def all_tags(raw: np.ndarray, data: bytes, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Tags of all records, in order: the records they are of, in no order, and their names, type letters and values.

    The n-th tags of all records are taken together; text and whole numbers, which most are,
    as columns, what else there is one by one.
    """
    owner, nth, names, kinds, values = [], [], [], [], []
    at, of, step = at.copy(), np.arange(len(at)), 0
    nul = np.flatnonzero(raw == 0)

    def found(rows: np.ndarray, name: pa.Array, kind: pa.Array, value: pa.Array) -> None:
        for held, new in ((owner, of[rows]), (nth, np.full(len(rows), step)), (names, name), (kinds, kind), (values, value)):
            held.append(new)

    def text(start: np.ndarray, size: np.ndarray) -> pa.Array:
        return pa.StringArray.from_buffers(len(start), offsets(size).buffers()[1], pa.py_buffer(raw[spread(start, size)].tobytes()))

    while True:
        left = np.flatnonzero(at < end)
        at, end, of = at[left], end[left], of[left]
        if not len(at):
            break
        code, name, next_ = raw[at + 2], text(at, np.full(len(at), 2)), np.zeros(len(at), np.int64)
        for letter in np.unique(code):
            rows, kind = np.flatnonzero(code == letter), chr(letter)
            start, own = at[rows] + 3, name.take(pa.array(rows))
            if kind in "ZH":
                stop = nul[np.searchsorted(nul, start)]
                found(rows, own, pa.repeat(kind, len(rows)), text(start, stop - start))
                next_[rows] = stop + 1
            elif kind in INTEGERS:
                form = np.dtype("<" + INTEGERS[kind])
                number = raw[start[:, None] + np.arange(form.itemsize)].copy().view(form).ravel()
                found(rows, own, pa.repeat("i", len(rows)), pa.array(number).cast(pa.string()))
                next_[rows] = start + form.itemsize
            else:
                told = [one_tag(data, int(x)) for x in at[rows]]
                found(rows, own, pa.array([k for k, _, _ in told], pa.string()), pa.array([v for _, v, _ in told], pa.string()))
                next_[rows] = [e for _, _, e in told]
        at, step = next_, step + 1
    if not owner:
        none = pa.array([], pa.string())
        return np.zeros(0, np.int64), none, none, none
    owners = np.concatenate(owner)
    order = pa.array(np.lexsort((np.concatenate(nth), owners)))
    return owners, *[pa.concat_arrays(x).take(order) for x in (names, kinds, values)]


def to_batch(data: bytes, starts: list[int], names: list[str], keep: Keep) -> pa.RecordBatch | None:
    """Records at the given places that are kept, as rows of SCHEMA; fields are gathered for all at once."""
    raw = np.frombuffer(data, np.uint8)
    at = np.asarray(starts, np.int64)
    fixed = raw[at[:, None] + np.arange(36)].copy().view(FIXED).ravel()
    on = keep.mask(fixed, names)
    at, fixed = at[on], fixed[on]
    n = len(at)
    if not n:
        return None
    lengths = {k: fixed[k].astype(np.int64) for k in ("name", "ops", "seq", "size")}
    text = lambda places, sizes, table=None: pa.StringArray.from_buffers(n, offsets(sizes).buffers()[1], pa.py_buffer((raw[places] if table is None else table[places]).tobytes()))
    place = at + 36
    name = text(spread(place, lengths["name"] - 1), lengths["name"] - 1)
    place = place + lengths["name"]
    ops = raw[spread(place, 4 * lengths["ops"])].copy().view("<u4")
    code, length = (ops & 15).astype(np.int8), (ops >> 4).astype(np.int32)
    cigar = pa.ListArray.from_arrays(offsets(lengths["ops"]), pa.StructArray.from_arrays([pa.DictionaryArray.from_arrays(pa.array(code), pa.array(list(OPS))).cast(pa.string()), pa.array(length)], names=["op", "len"]))
    of = np.repeat(np.arange(n), lengths["ops"])
    span = np.bincount(of, length * np.isin(code, [OPS.index(c) for c in ON_REFERENCE]), n).astype(np.int64)
    place = place + 4 * lengths["ops"]
    half = raw[spread(place, (lengths["seq"] + 1) // 2)]
    pairs = np.stack([half >> 4, half & 15], 1).ravel()
    both = 2 * ((lengths["seq"] + 1) // 2)
    letters = pairs[spread(np.cumsum(both) - both, lengths["seq"])]
    bases = text(letters, lengths["seq"], np.frombuffer(BASES.encode(), np.uint8))
    bases = pc.if_else(pa.array(lengths["seq"] == 0), "*", bases)
    place = place + (lengths["seq"] + 1) // 2
    quals = raw[spread(place, lengths["seq"])]
    missing = np.zeros(n, bool)
    full = lengths["seq"] > 0
    missing[full] = raw[place[full]] == 255
    shown = np.where(missing, 0, lengths["seq"])
    quals = pa.ListArray.from_arrays(offsets(shown), pa.array(quals[np.repeat(~missing, lengths["seq"])].astype(np.int32)))
    place = place + lengths["seq"]
    owner, tag, kind, value = all_tags(raw, data, place, at + 4 + lengths["size"])
    n_tags = np.bincount(owner, minlength=n)
    group = np.full(n, -1)  # the first tag RG of each record
    grouped = np.flatnonzero(pc.equal(tag, "RG").to_numpy(zero_copy_only=False))
    group[np.sort(owner)[grouped][::-1]] = grouped[::-1]
    read_group = value.take(pa.array(group, mask=group < 0))
    table = np.array([*names, "*"], object)
    start = fixed["pos"] + 1
    columns = [
        name, pa.array(table[fixed["ref"]], pa.string()), pa.array(start), pa.array((start + span - 1).astype(np.int32)), pa.array(fixed["mapq"].astype(np.int32)),
        *[pa.array((fixed["flag"] & bit) != 0) for bit in FLAGS.values()],
        cigar, pa.array(table[fixed["mate_ref"]], pa.string()), pa.array(fixed["mate_pos"] + 1), pa.array(fixed["tlen"].astype(np.int32)), bases, quals,
        pa.MapArray.from_arrays(offsets(n_tags), tag, value), pa.MapArray.from_arrays(offsets(n_tags), tag, kind), read_group,
    ]
    return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int
    names: list[str]
    header: int  # bytes of the header, uncompressed


def read_range(part: Range, keep: Keep, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The kept records that begin in a range of a file."""
    system, at = store(part.path)
    with system.open_input_file(at) as file:
        data, ends, own = b"", [], 0  # ends: where blocks end in data; own: data that may begin a record here
        source = blocks(file, part.start, part.size)
        skip, synced = (part.header, True) if part.start == 0 else (0, False)
        done = False
        starts: list[int] = []

        def more() -> bool:
            nonlocal data, own, done
            for where, content in source:
                if where < part.end:
                    own += len(content)
                else:
                    done = True
                data += content
                return True
            done = True
            return False

        place = 0
        while more() and not done:
            if skip:
                gone = min(skip, len(data))
                data, own, skip = data[gone:], own - gone, skip - gone
                if skip:
                    continue
            if not synced:
                # look a little beyond, so that a chain can be seen
                while len(data) < 1 << 18 and more():
                    pass
                found = first_record(data, len(part.names))
                if found is None or found >= own:
                    if done or own <= 0:
                        return
                    if len(data) > 1 << 26:
                        raise ValueError(f"no record found in {part.path} from {part.start}")
                    # a record longer than all of this: look again with more
                    if found is None:
                        continue
                place, synced = found, True
            while True:
                if place + 4 > len(data) or place + 4 + struct.unpack_from("<i", data, place)[0] > len(data):
                    if place < own and done:
                        if more():
                            continue
                        if place < len(data):
                            raise ValueError(f"{part.path} ends within a record")
                    break
                if place >= own:
                    break
                starts.append(place)
                place += 4 + struct.unpack_from("<i", data, place)[0]
                if len(starts) >= rows:
                    yield from filter(None, [to_batch(data, starts, part.names, keep)])
                    data, own, place, starts = data[place:], own - place, 0, []
            if place >= own and done:
                break
        # what began here and ends beyond
        while synced and place < own:
            while place + 4 > len(data) or place + 4 + struct.unpack_from("<i", data, place)[0] > len(data):
                if not more():
                    raise ValueError(f"{part.path} ends within a record")
            starts.append(place)
            place += 4 + struct.unpack_from("<i", data, place)[0]
        if starts:
            yield from filter(None, [to_batch(data, starts, part.names, keep)])


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int, keep: Keep):
        self.path, self.split, self.keep = path, split, keep

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files(self.path):
            text, references = header(path)
            length = 12 + len(text.encode()) + sum(9 + len(n.encode()) for n, _ in references)
            system, at = store(path)
            with system.open_input_file(at) as file:  # the text may be padded
                first = next(blocks(file, 0, size))[1]
                length += struct.unpack_from("<i", first, 4)[0] - len(text.encode())
            names = [n for n, _ in references]
            out += [Range(path, a, min(a + self.split, size), size, names, length) for a in range(0, size, self.split)]
        return out or [Range("", 0, 0, 0, [], 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_range(partition, self.keep)


class PushingBamReader(BamReader):
    """With filters of the query; Spark wants such a reader only where it is set to push them."""

    def pushFilters(self, filters: list[Filter]):
        """Flags, mapping quality and contig are checked here; the rest stays with Spark."""
        for f in filters:
            turned = isinstance(f, Not)
            inner = f.child if turned else f
            name = inner.attribute[0] if hasattr(inner, "attribute") and len(inner.attribute) == 1 else ""
            if isinstance(inner, EqualTo) and name in FLAGS and isinstance(inner.value, bool) and self.keep.flags.get(name, inner.value != turned) == (inner.value != turned):
                self.keep.flags[name] = inner.value != turned
            elif not turned and isinstance(inner, GreaterThanOrEqual | GreaterThan) and name == "mapq":
                self.keep.least = max(self.keep.least, inner.value + isinstance(inner, GreaterThan))
            elif not turned and isinstance(inner, EqualTo | In) and name == "contig" and self.keep.contigs is None:
                self.keep.contigs = list(inner.value) if isinstance(inner, In) else [inner.value]
            else:
                yield f


# ---- writing ----------------------------------------------------------------------------


def bin_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the smallest bins of the binning scheme that hold [start, end), from 0."""
    out, last = np.zeros(len(start), np.int64), end - 1
    for shift, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(start >> shift == last >> shift, base + (start >> shift), out)
    return out


def tag_bytes(tag: str, kind: str, value: str) -> bytes:
    head = tag.encode()
    if kind == "i":
        x = int(value)
        for code, form, low, high in (("c", "b", -128, 127), ("C", "B", 0, 255), ("s", "h", -(1 << 15), (1 << 15) - 1), ("S", "H", 0, (1 << 16) - 1), ("i", "i", -(1 << 31), (1 << 31) - 1), ("I", "I", 0, (1 << 32) - 1)):
            if low <= x <= high:
                return head + code.encode() + struct.pack(f"<{form}", x)
        raise ValueError(f"{tag}: {x} is out of range")
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return head + b"A" + value.encode()
    if kind == "B":
        sub, *values = value.split(",")
        form = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[sub]
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{form}", len(values), *[float(v) if sub == "f" else int(v) for v in values])
    return head + kind.encode() + value.encode() + b"\0"


CODES = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASES):
    CODES[[ord(_c), ord(_c.lower())]] = _i


def texts(column: pa.Array, default: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, one after another, and how many each has."""
    column = pc.fill_null(column, default).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    held = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return held[ends[0] : ends[-1]], np.diff(ends)


def listed(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Items of all lists or maps of a column, and how many each has."""
    if isinstance(column, pa.MapArray):
        column = column.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def tags_bytes(attrs: pa.Array, types: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tags of all rows as bytes, and how many bytes each row has; tags without a type are text.
    A tag is encoded once for each of its values."""
    items, n = listed(attrs)
    typed, m = listed(types)
    key, value = items.field("key"), items.field("value")
    row = np.repeat(np.arange(len(n)), n)
    if len(typed) == len(items) and (n == m).all() and pc.all(pc.equal(key, typed.field("key"))).as_py() is not False:
        kind = pc.fill_null(typed.field("value"), "Z")
    else:
        by = dict(zip(zip(np.repeat(np.arange(len(m)), m).tolist(), typed.field("key").to_pylist(), strict=True), typed.field("value").to_pylist(), strict=True))
        kind = pa.array([by.get(at, "Z") for at in zip(row.tolist(), key.to_pylist(), strict=True)], pa.string())
    coded = pc.binary_join_element_wise(key, kind, value, "\0").dictionary_encode()
    each = pa.array([tag_bytes(*t.split("\0", 2)) for t in coded.dictionary.to_pylist()], pa.binary())
    held, size = texts(each.take(coded.indices), "")
    return held, np.bincount(row, size, len(n)).astype(np.int64)


def records(batch: pa.RecordBatch, references: list[str]) -> bytes:
    """Rows of SCHEMA as alignment records, a field of all of them at a time."""
    n = batch.num_rows
    col = lambda k: batch.column(batch.schema.get_field_index(k))
    whole = lambda k: pc.fill_null(col(k), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = lambda k: pc.fill_null(pc.index_in(col(k), pa.array(references, pa.string())), -1).to_numpy(zero_copy_only=False)
    flag = np.zeros(n, np.int64)
    for k, bit in FLAGS.items():
        flag |= np.where(pc.fill_null(col(k), False).to_numpy(zero_copy_only=False), bit, 0)
    name, named = texts(col("name"), "*")
    ops, n_ops = listed(col("cigar"))
    code = pc.index_in(ops.field("op"), pa.array(list(OPS)))
    if code.null_count:
        raise ValueError("unknown operation in a CIGAR")
    code, length = code.to_numpy().astype(np.int64), ops.field("len").to_numpy(zero_copy_only=False).astype(np.int64)
    span = np.bincount(np.repeat(np.arange(n), n_ops), length * np.isin(code, [OPS.index(c) for c in ON_REFERENCE]), n).astype(np.int64)
    text = pc.fill_null(col("bases"), "")
    text = pc.replace_substring_regex(pc.if_else(pc.equal(text, "*"), "", text), "[^\\x00-\\x7f]", "N")
    base, size = texts(text, "")
    half = (size + 1) // 2
    nibbles = np.zeros(2 * int(half.sum()), np.uint8)
    nibbles[spread(2 * (np.cumsum(half) - half), size)] = CODES[base]
    told, n_told = listed(col("quals"))
    fits = (n_told == size) & (size > 0)
    quals = np.full(int(size.sum()), 255, np.uint8)
    quals[np.repeat(fits, size)] = told.filter(pa.array(np.repeat(fits, n_told))).cast(pa.uint8()).to_numpy()
    tags, tagged = tags_bytes(col("attrs"), col("tag_types"))
    start, mapq = whole("start") - 1, whole("mapq")
    if n and not (0 <= mapq.min() and mapq.max() <= 255 and named.max() < 255):
        raise ValueError("mapping qualities are 0 to 255, names at most 254 bytes")
    fixed = np.zeros(n, FIXED)
    parts = [(name, named), (np.zeros(n, np.uint8), np.ones(n, np.int64)), ((length << 4 | code).astype("<u4").view(np.uint8), 4 * n_ops), (nibbles[::2] << 4 | nibbles[1::2], half), (quals, size), (tags, tagged)]
    total = 36 + sum(s for _, s in parts)
    fields = {
        "size": total - 4, "ref": number("contig"), "pos": start, "name": named + 1, "mapq": mapq, "bin": np.where(start >= 0, bin_of(start, start + np.maximum(span, 1)), 4680) & 0xFFFF, "ops": n_ops,
        "flag": flag, "seq": size, "mate_ref": number("mate_contig"), "mate_pos": whole("mate_start") - 1, "tlen": whole("template_len"),
    }
    for k, v in fields.items():
        fixed[k] = v
    out = np.zeros(int(total.sum()), np.uint8)
    place = np.cumsum(total) - total
    for held, sizes in [(fixed.view(np.uint8), np.full(n, 36)), *parts]:
        out[spread(place, sizes)] = held
        place = place + sizes
    return out.tobytes()


def deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class BamWriter(DataSourceArrowWriter):
    """A file a task, with the header in each.  Files get their names when all are there, so
    a task that is repeated leaves nothing twice."""

    def __init__(self, path: str, references: list[tuple[str, int]], program: str, block: int, overwrite: bool):
        self.path, self.references, self.program, self.block, self.overwrite = path, references, program, block, overwrite
        self.job = uuid.uuid4().hex

    def head(self) -> bytes:
        lines = ["@HD\tVN:1.6\tSO:unsorted", *[f"@SQ\tSN:{n}\tLN:{size}" for n, size in self.references], f"@PG\tID:{self.program}\tPN:{self.program}"]
        text = "".join(x + "\n" for x in lines).encode()
        out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.references))
        return out + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.references)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = store(self.path)
        names = [n for n, _ in self.references]
        system.create_dir(f"{base}/_temporary-{self.job}", recursive=True)
        path = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}"
        n = 0
        with system.open_output_stream(path) as out:
            held = self.head()
            for batch in iterator:
                n += batch.num_rows
                held += records(batch, names) if batch.num_rows else b""
                full = len(held) - len(held) % self.block
                for at in range(0, full, self.block):
                    out.write(deflated(held[at : at + self.block]))
                held = held[full:]
            out.write(deflated(held) + EOF)
        return Written(path if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = store(self.path)
        if self.overwrite:
            for old, _ in files(self.path):
                system.delete_file(store(old)[1])
        for i, m in enumerate(m for m in messages if m and m.path):
            system.move(m.path, f"{base}/part-{i:05d}-{self.job}.bam")
        system.delete_dir(f"{base}/_temporary-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = store(self.path)
        if system.get_file_info(f"{base}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_temporary-{self.job}")


class Bam(DataSource):
    """``format("bam")``.  Options of reads: path, split (bytes), keep (JSON of Keep's fields).
    Of writes: path, references (JSON of [name, length]), program, block (bytes, at most 65,280)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        kind = PushingBamReader if self.options.get("pushdown", "false") == "true" else BamReader
        return kind(self.options["path"], int(self.options.get("split", 32 << 20)), Keep(**json.loads(self.options.get("keep", "{}"))))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        references = [tuple(x) for x in json.loads(self.options["references"])]
        return BamWriter(self.options["path"], references, self.options.get("program", "locusframe"), min(int(self.options.get("block", 65_280)), 65_280), overwrite)


def read(spark: SparkSession, path: str, split: int = 32 << 20, flags: dict[str, bool] | None = None, min_mapq: int = 0, contigs: list[str] | None = None) -> DataFrame:
    """Alignments of a BAM file or a folder of them, as rows of SCHEMA.

    ``flags`` (such as ``{"unmapped": False}``), ``min_mapq`` and ``contigs`` are checked in
    the reader before a record is decoded.  Filters of the query are checked there as well
    where ``spark.sql.python.filterPushdown.enabled`` is set.
    """
    spark.dataSource.register(Bam)
    keep = json.dumps({"flags": flags or {}, "least": min_mapq, "contigs": contigs})
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("bam").option("pushdown", pushdown).option("split", split).option("keep", keep).load(path)


def write(reads: DataFrame, path: str, references: list[tuple[str, int]], program: str = "locusframe", block: int = 65_280) -> None:
    """Write rows of SCHEMA, unsorted, with a program record; contigs that aren't among the references count as none."""
    reads.sparkSession.dataSource.register(Bam)
    typed = reads.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMA)])
    typed.write.format("bam").option("references", json.dumps(references)).option("program", program).option("block", block).mode("append").save(path)
