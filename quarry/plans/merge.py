"""Sums of numeric arrays over tasks, merged by a shuffle with one accumulator in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART = "slot long, task int, m binary"


def part(slot: int, task: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([task], pa.int32()), pa.array([m.tobytes()], pa.binary())],
                                      ["slot", "task", "m"])


def merged(parts: DataFrame, dtype=np.float64) -> DataFrame:
    """One row for each (slot, task) of ``parts``: the sum of its arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for slot, task, m in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(m, dtype)
                if (slot, task) == key:
                    total += x
                    continue
                if key is not None:
                    yield part(*key, total)
                key, total = (slot, task), x.copy()
        if key is not None:
            yield part(*key, total)

    return parts.repartition("slot", "task").sortWithinPartitions("slot", "task").mapInArrow(run, PART)
