"""Helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts(column: pa.Array, at_once: int = 256) -> Iterator[str]:
    """The strings of a column, a few in memory at a time; null counts as empty."""
    for a in range(0, len(column), at_once):
        yield from ("" if t is None else t for t in column.slice(a, at_once).to_pylist())


def utf8(column: pa.Array, at_once: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, a few in memory at a time; null counts as empty."""
    for a in range(0, len(column), at_once):
        yield from (b"" if t is None else t for t in column.slice(a, at_once).cast(pa.binary()).to_pylist())


def released(work: Callable) -> Callable:
    """``work`` over batches, giving freed memory back to the system after each task.

    Python workers are reused and share an executor's memory with the JVM.
    """
    @functools.wraps(work)
    def task(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim:
                trim(0)

    return task


def lists(rows: np.ndarray) -> pa.Array:
    """A list column from a matrix, one list per row."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(rows.reshape(-1)))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal, non-null keys.

    The partition is sorted by the keys, so a run is a whole group; it may
    reach over several batches. One group is held at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        new[0] = not held
        for key in keys:
            column = batch.column(key)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            new[0] |= bool(held) and held[-1].column(key)[-1].as_py() != column[0].as_py()
        starts = np.flatnonzero(new).tolist()
        if not starts:
            held.append(batch)
            continue
        if starts[0] > 0:
            held.append(batch.slice(0, starts[0]))
        if held:
            yield pa.Table.from_batches(held)
        for start, end in zip(starts, starts[1:]):
            yield pa.Table.from_batches([batch.slice(start, end - start)])
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)
