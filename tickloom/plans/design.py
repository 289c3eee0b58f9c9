"""Stored design tables and sums over them: one aggregate per step of an iterative fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import staged


def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


#: Bytes of a block of rows as stored, about, and rows that are worked on at a time.
BLOCK_BYTES = 8192
CHUNK_ROWS = 1 << 13


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.ones((batch.num_rows, 1 + batch.num_columns))
        for i in range(batch.num_columns):
            rows[:, i + 1] = batch.column(i).to_numpy(zero_copy_only=False)
        size = rows.itemsize * rows.shape[1]
        starts = np.r_[np.arange(0, len(rows), max(1, BLOCK_BYTES // size)), len(rows)].astype("int32") * np.int32(size)
        block = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(rows)])
        yield pa.RecordBatch.from_arrays([block], names=["block"])


def design_table(rows: DataFrame, inputs: list[str], n_targets: int, *more: Column) -> DataFrame:
    """1, the inputs, ``y`` and further numbers of each row, written once; rows with a missing or infinite value go.

    Rows are packed in blocks of doubles, which tasks read as they are: every step of a fit reads all of them.
    """
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)]
    y = [F.get("y", F.lit(i)).cast("double").alias(f"y{i}") for i in range(n_targets)]
    table = rows.select(F.size("y").alias("_targets"), *x, *y, *[c.cast("double").alias(f"more{i}") for i, c in enumerate(more)])
    good, numbers = F.col("_targets") == n_targets, table.columns[1:]
    for c in numbers[: len(x) + len(y)]:
        good = good & _usable(F.col(c))
    return staged(table.where(good).select(*numbers).mapInArrow(_packed, "block binary"), "design")


def chunks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """The rows of a design table's batches, a portion at a time."""
    for batch in batches:
        block = batch.column(0)
        if not len(block):
            continue
        starts = np.frombuffer(block.buffers()[1], "int64" if pa.types.is_large_binary(block.type) else "int32")[block.offset : block.offset + len(block) + 1]
        rows = np.frombuffer(block.buffers()[2], "float64", int(starts[-1] - starts[0]) // 8, int(starts[0])).reshape(-1, columns)
        for at in range(0, len(rows), CHUNK_ROWS):
            yield rows[at : at + CHUNK_ROWS]


def sums_over(design: DataFrame, fn: Callable[..., np.ndarray], size: int, width: int, n_targets: int, extra: int = 0) -> np.ndarray:
    """The ``size`` sums of ``fn(x, y)`` over all rows; with ``extra`` columns behind ``y`` these are further arguments.

    Tasks add up their own portions; what is shuffled is ``size`` numbers a task, what reaches the driver ``size`` numbers.
    """

    def partial(batches):
        total = np.zeros(size)
        for rows in chunks(batches, width + n_targets + extra):
            total += fn(rows[:, :width], rows[:, width : width + n_targets], *rows[:, width + n_targets :].T)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in design.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def least_squares(design: DataFrame, width: int, n_targets: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Row count, coefficients (one row per target), deviations of the residuals, and sums of products of ``x``, from one pass."""

    def products(x, y):
        return np.concatenate([[len(x)], (x.T @ x).ravel(), (x.T @ y).ravel(), (y * y).sum(0)])

    sums = sums_over(design, products, 1 + width * width + width * n_targets + n_targets, width, n_targets)
    n, rest = sums[0], sums[1:]
    xx, xy, yy = rest[: width * width].reshape(width, width), rest[width * width : -n_targets].reshape(width, n_targets), rest[-n_targets:]
    found = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    left = np.maximum(yy - (found * xy).sum(0), 0.0)
    return n, found.T, np.sqrt(left / max(n, 1.0)), xx
