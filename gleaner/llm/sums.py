"""Sums of long arrays over all rows, added in a fixed order, so that a rerun gives the same digits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gleaner.llm.common import arrow_batches

#: Tasks that add up the arrays of all others, so that the driver gets this many whatever the number of tasks.
LANES = 8
#: Up to so many tasks send their arrays to the driver themselves.
DIRECT_TASKS = 64
#: Bytes of a stored table that a task of a pass should read at least, unless cores would be idle.
TASK_BYTES = 32 << 20
SCHEMA = "at bigint, v array<double>"


def _row(at: int, total: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total, pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), values], ["at", "v"])


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    return (column.slice(i, 1).flatten().to_numpy() for i in range(len(column)))


def _lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((at, v.copy()) for b in batches for at, v in zip(b.column("at").to_pylist(), _arrays(b.column("v")))), key=lambda r: r[0])
    if rows:
        yield _row(rows[0][0], np.sum([v for _, v in rows], axis=0))


def summed(rows: DataFrame, width: int, add: Callable[[pa.RecordBatch], np.ndarray], batch_rows: int, direct: bool) -> np.ndarray:
    """The sum over the Arrow batches of ``rows`` of ``add(batch)``, ``width`` numbers.

    Every task returns one array. With ``direct`` they go to the driver, else ``LANES`` tasks add them up before; the order of
    adding is that of the tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += add(batch)
        yield _row(TaskContext.get().partitionId(), total)

    with arrow_batches(rows.sparkSession, batch_rows):
        sums = rows.mapInArrow(partial, SCHEMA)
        table = (sums if direct else sums.repartition(LANES).mapInArrow(_lane, SCHEMA)).toArrow().sort_by("at").combine_chunks()
    arrays = [v for batch in table.to_batches() for v in _arrays(batch.column("v"))]
    return np.sum(arrays, axis=0) if arrays else np.zeros(width)


def for_passes(stored: DataFrame) -> DataFrame:
    """A stored table for many short passes: small files are read together, without a shuffle, so a pass has as many tasks as cores or as its size asks for."""
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return stored.coalesce(max(stored.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def few_tasks(stored: DataFrame) -> bool:
    """Whether a pass over a stored table has at most ``DIRECT_TASKS`` tasks."""
    return stored.rdd.getNumPartitions() <= DIRECT_TASKS
