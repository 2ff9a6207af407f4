"""Corpus statistics in tables of fixed shape: every task counts into its own, and the tables are summed by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a block, the unit that is shuffled and summed.
BLOCK = 1 << 15
#: Tasks that add up a block before the last one does.
PARTS = 16
SUMS = "block long, counts binary"


def _sum(batches) -> Iterator[pa.RecordBatch]:
    block, total = None, None
    for batch in batches:
        for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(counts.as_buffer(), np.int64)
            if b != block:
                if block is not None:
                    yield _row(block, total)
                block, total = b, part.copy()
            else:
                total += part
    if block is not None:
        yield _row(block, total)


def _row(block: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


def counted(docs: DataFrame, size: int, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of what ``count`` makes of a task's batches: ``size`` integers, whatever the corpus holds."""

    def run(batches):
        whole = count(batches).astype(np.int64)
        for i in range(0, size, BLOCK):
            if whole[i : i + BLOCK].any():
                yield _row(i // BLOCK, whole[i : i + BLOCK])

    # Blocks of the tasks' tables meet in PARTS tasks each, and what those add up meets in one; tables are added one at a time.
    parts = docs.mapInArrow(run, SUMS).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    halfway = parts.repartition("block", "part").sortWithinPartitions("block", "part").select("block", "counts").mapInArrow(_sum, SUMS)
    summed = halfway.repartition("block").sortWithinPartitions("block").mapInArrow(_sum, SUMS)
    out = np.zeros(size, np.int64)
    for r in summed.collect():
        part = np.frombuffer(r.counts, np.int64)
        out[r.block * BLOCK : r.block * BLOCK + len(part)] = part
    return out
