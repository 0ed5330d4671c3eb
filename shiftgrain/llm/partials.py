"""Sums of equally long number arrays over all tasks, added up in a tree on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shiftgrain.llm.common import stage

#: Arrays that one task of a level adds up, and that the driver adds up at the end.
FAN = 32

_SCHEMA = "part long, body binary"


def _rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "body"]
    )


def total(table: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], kind: type) -> np.ndarray | None:
    """The sum of `kernel(batch)`, an array of `kind` of fixed length, over all batches of `table`; None without rows.

    Each task sends one array; levels of at most FAN arrays a task shrink them until the driver gets
    FAN at most, whatever the number of tasks.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                part = np.ascontiguousarray(kernel(batch), kind)
                sums = part if sums is None else sums + part
        if sums is not None:
            yield _rows({TaskContext.get().partitionId(): sums})

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist()):
                own = np.frombuffer(body, kind)
                sums[part] = sums[part] + own if part in sums else own
        if sums:
            yield _rows(sums)

    found = stage(table.mapInArrow(local, _SCHEMA))
    n = found.count()
    while n > FAN:
        parts = -(-n // FAN)
        found = stage(found.selectExpr(f"part % {parts} AS part", "body").repartition(parts, "part").mapInArrow(level, _SCHEMA))
        n = found.count()
    arrays = [np.frombuffer(r["body"], kind) for r in found.orderBy("part").collect()]
    return sum(arrays[1:], arrays[0]) if arrays else None


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of `width` numbers without nulls as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
