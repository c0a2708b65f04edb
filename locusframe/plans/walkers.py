"""Walkers of one's own: a map and a reduce in Python that run over any rows.

A walker folds rows into a state, merges states, and turns the last one into rows.  By key it
runs on what Spark deals out by that key; without one each task folds its own rows, and
the states, one a task, are merged in a tree, so no task sees more than ``FAN`` of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.sources.shared import cut

#: States that are merged in one task.
FAN = 32


@dataclass
class Walker:
    """``needs``: columns; ``keep``: a predicate in SQL, applied before Python; ``start`` makes a state;
    ``add(state, row)`` and ``merge(state, state)`` give the next one; ``finish(state)`` gives
    rows of ``schema``.  States have to be picklable, and ``merge`` must not depend on the order."""

    needs: list[str]
    start: Callable[[], Any]
    add: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], list[tuple]]
    schema: str
    keep: str | None = None


def folded(walker: Walker, batches: Iterator[pa.RecordBatch]) -> Any:
    state = walker.start()
    for batch in batches:
        for row in batch.select(walker.needs).to_pylist():
            state = walker.add(state, row)
    return state


def run(walker: Walker, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The walker's rows, with ``keys`` one result a key; without rows and keys the start's result."""
    kept = rows if walker.keep is None else rows.where(walker.keep)
    w = Walker(walker.needs, walker.start, walker.add, walker.merge, walker.finish, walker.schema)
    names = [c.split()[0] for c in walker.schema.split(", ")]
    state_of = lambda part, state: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([cloudpickle.dumps(state)], pa.binary())], names=["part", "state"])
    if not keys:
        parts = kept.select(*walker.needs).rdd.getNumPartitions()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            yield state_of(TaskContext.get().partitionId(), folded(w, batches))

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, Any] = {}
            for batch in batches:
                for part, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    state = pickle.loads(raw)
                    found[part] = w.merge(found[part], state) if part in found else state
            for part, state in found.items():
                yield state_of(part, state)

        # a start goes along, so that no rows have a result too
        none = kept.sparkSession.createDataFrame([(0, cloudpickle.dumps(w.start()))], "part long, state binary")
        states = kept.select(*walker.needs).mapInArrow(partial, "part long, state binary").unionByName(none)
        parts += 1
        while parts > 1:
            parts = -(-parts // FAN)
            states = states.select((F.col("part") % parts).alias("part"), "state").repartition(parts, "part").mapInArrow(merged, "part long, state binary")

        def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(1).to_pylist():
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(w.finish(pickle.loads(raw)), columns=names), preserve_index=False)

        return states.mapInArrow(finished, walker.schema)

    kinds = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)

    # a key's rows are folded where they are, and its states, one a task, meet by key
    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Any] = {}
        for batch in batches:
            for row in batch.to_pylist():
                k = tuple(row[c] for c in keys)
                found[k] = w.add(found[k] if k in found else w.start(), row)
            if len(found) >= 1 << 16:
                yield states_of(found)
                found = {}
        if found:
            yield states_of(found)

    def states_of(found: dict[tuple, Any]) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in found]) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([cloudpickle.dumps(s) for s in found.values()], pa.binary())], names=[*keys, "_state"])

    def close(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(x) for x in pdf["_state"]]
        state = states[0]
        for s in states[1:]:
            state = w.merge(state, s)
        return pd.DataFrame([(*key, *r) for r in w.finish(state)], columns=[*keys, *names])

    columns = list(dict.fromkeys([*keys, *walker.needs]))
    states = cut(kept.select(*columns).mapInArrow(by_key, f"{kinds}, _state binary"))
    return states.groupBy(*keys).applyInPandas(close, f"{kinds}, {walker.schema}")
