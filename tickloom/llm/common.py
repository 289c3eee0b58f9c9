"""Shared pieces of the text operators: bounded Arrow batches, safe columns, key-sorted groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: a batch of texts of some 100 KB each stays far below a worker's memory.
BATCH_ROWS = 256

#: Fixed odd bases of the two rolling polynomials (any odd 64-bit numbers do).
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def bounded_batches(spark: SparkSession) -> None:
    """Cap the rows of an Arrow batch, so that a run of very long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fields(df: DataFrame, **types: str) -> DataFrame:
    """Exactly the named columns with the given types; others go, missing ones are null.

    The first step of every digest query: extra columns, whatever they are called, cannot clash.
    """
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def sample_keys(rows: DataFrame, key: str, n: int, total: int, spare: int) -> list:
    """Up to ``n`` keys of ``rows`` in the order of a hash, for samples whose size is a documented bound.

    ``total`` is the number of ``rows``: it thins them by another hash to about ``spare * n``
    before they are ordered, so that what tasks send does not grow with their number.
    """
    thin = max(1, total // (spare * n))
    kept = rows.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(thin)) == 0))
    return [r[0] for r in kept.select(key).orderBy(F.xxhash64(key, F.lit(1)), key).limit(n).collect()]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition sorted by ``keys``: several complete groups at a time.

    The last group of a batch may go on in the next batch, so it is held back until it is closed.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= v[0] != held[-1].column(k)[held[-1].num_rows - 1].as_py()
        cuts = np.flatnonzero(change)
        if len(cuts) == 0:
            held.append(batch)
            continue
        if cuts[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(int(cuts[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers where the groups of a key-sorted table begin, and the row count at the end."""
    if table.num_rows == 0:
        return np.zeros(1, np.int64)
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (in place), so that their order looks random."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up, self.down


class Rolling:
    """Hash of any slice of a byte array, from prefix sums of byte times power."""

    def __init__(self, data: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``data[start:end]`` for arrays of bounds; equal slices hash alike wherever they stand."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])
