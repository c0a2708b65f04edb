"""Indexed FASTA as a Spark data source: chunks of sequences, read in parallel by offset.

The index tells where each sequence begins and how its lines are wrapped, so any stretch of
a sequence is a stretch of bytes: a chromosome is read by as many tasks as it has chunks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusframe.sources.bam import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "contig string, chunk_start long, seq string"


@dataclass
class Stretch(InputPartition):
    contig: str
    length: int
    offset: int
    bases: int
    width: int
    first: int  # chunks of this task
    last: int


class FastaReader(DataSourceReader):
    def __init__(self, path: str, index: str, chunk: int, per_task: int):
        self.path, self.index, self.chunk, self.per_task = path, index, chunk, per_task

    def partitions(self) -> list[Stretch]:
        system, at = store(self.index)
        with system.open_input_stream(at) as file:
            rows = [line.split("\t") for line in file.read().decode().splitlines() if line]
        out = []
        for contig, *numbers in rows:
            length, offset, bases, width = map(int, numbers[:4])
            chunks = -(-length // self.chunk)
            out += [Stretch(contig, length, offset, bases, width, k, min(k + self.per_task, chunks)) for k in range(0, chunks, self.per_task)]
        return out or [Stretch("", 0, 0, 1, 1, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        system, at = store(self.path)
        place = lambda i: p.offset + i // p.bases * p.width + i % p.bases  # noqa: E731  of base i, from 0
        with system.open_input_file(at) as file:
            for k in range(p.first, p.last):
                a, b = k * self.chunk, min((k + 1) * self.chunk, p.length)
                file.seek(place(a))
                raw = file.read(place(b - 1) + 1 - place(a))
                seq = raw.replace(b"\n", b"").replace(b"\r", b"").decode().upper()
                if len(seq) != b - a:
                    raise ValueError(f"{self.path} and its index disagree at {p.contig}:{a + 1}")
                yield pa.RecordBatch.from_arrays([pa.array([p.contig]), pa.array([a + 1], pa.int64()), pa.array([seq])], names=["contig", "chunk_start", "seq"])


class Fasta(DataSource):
    """``format("indexed_fasta")``.  Options: path, index (path + ".fai"), chunk (bases), per_task (chunks)."""

    @classmethod
    def name(cls) -> str:
        return "indexed_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        o = self.options
        return FastaReader(o["path"], o.get("index", o["path"] + ".fai"), int(o.get("chunk", 1 << 16)), int(o.get("per_task", 64)))


def read(spark: SparkSession, path: str, index: str | None = None, chunk: int = 1 << 16, per_task: int = 64) -> DataFrame:
    """Chunks ``contig, chunk_start, seq`` of a FASTA file with an index, in upper case."""
    spark.dataSource.register(Fasta)
    return spark.read.format("indexed_fasta").option("index", index or path + ".fai").option("chunk", chunk).option("per_task", per_task).load(path)
