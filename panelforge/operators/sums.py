"""Sums of numpy arrays over all rows of a table, a bounded number of lines of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def added_up(rows: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray], lines: int, alone: bool = False) -> np.ndarray | None:
    """The sum over all batches of ``step``, an array of ``lines`` lines; None without rows.

    A task adds its batches up and hands on one row a line; the lines are dealt out and added up by tasks, so the
    driver gets each once. ``alone``: the rows are one partition, whose task has the sums already.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = step(batch)
                total = found if total is None else total + found
        if total is not None:
            yield _packed(enumerate(total))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                total[k] = total.get(k, 0.0) + np.frombuffer(raw)
        yield _packed(total.items())

    schema = "line int, sums binary"
    parts = rows.mapInArrow(each, schema)
    parts = parts if alone else parts.repartition("line").mapInArrow(joined, schema)
    found = {r.line: np.frombuffer(r.sums) for r in parts.collect()}
    return np.stack([found[k] for k in range(lines)]) if found else None


def _packed(lines: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    lines = list(lines)
    at, sums = [k for k, _ in lines], [np.ascontiguousarray(x, dtype=float).tobytes() for _, x in lines]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums, pa.binary())], names=["line", "sums"])
