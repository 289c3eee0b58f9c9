"""Positions in a global order without a single-task sort.

``Window.orderBy`` without a partition moves every row into one task. Here the keys are
range-partitioned and sorted, each row's place inside its partition comes from
``monotonically_increasing_id`` and only one count per partition reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.session import staged


def _pid() -> Column:
    return F.shiftright(F.col("_mid"), 33)


def _local() -> Column:
    return F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))


def _range_sorted(df: DataFrame, cols: list[str]) -> DataFrame:
    # written, so that all uses see one and the same partitioning
    return staged(df.orderBy(*cols).withColumn("_mid", F.monotonically_increasing_id()), "ordered")


def _starts(sizes: dict[int, int]) -> tuple[list[int], int]:
    """Running start per partition number, and the total."""
    starts, total = [], 0
    for pid in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(pid, 0)
    return starts, total


def dense_index(df: DataFrame, col: str, name: str) -> tuple[DataFrame, int]:
    """``(dimension, size)``: every distinct non-null ``col`` with its 0-based rank."""
    ordered = _range_sorted(df.select(col).where(F.col(col).isNotNull()).distinct(), [col])
    sizes = {r["pid"]: r["n"] for r in ordered.groupBy(_pid().alias("pid")).agg(F.count("*").alias("n")).collect()}
    starts, total = _starts(sizes)
    offsets = F.array(*[F.lit(s).cast("long") for s in starts]) if starts else F.array(F.lit(0).cast("long"))
    rank = F.element_at(offsets, (_pid() + 1).cast("int")) + _local()
    return ordered.select(col, rank.cast("int").alias(name)), total


@dataclass(frozen=True)
class KeyAt:
    """The row at a global position of an order over two unique key columns."""

    major: object
    minor: object
    total: int


def _row_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("_n"))


def _locate(counts: DataFrame, key: str, position_of) -> tuple[object, int, int]:
    """``(key, rows before it, total)`` for the key whose rows cover the wanted position."""
    ordered = _range_sorted(counts, [key])
    sizes = {r["pid"]: r["n"] for r in ordered.groupBy(_pid().alias("pid")).agg(F.sum("_n").alias("n")).collect()}
    starts, total = _starts(sizes)
    position = position_of(total)
    if not 0 <= position < total:
        return None, 0, total
    pid = max(p for p, start in enumerate(starts) if start <= position and sizes.get(p, 0))
    # only the keys of that one range partition are walked
    running = F.sum("_n").over(Window.partitionBy("_pid").orderBy(key))
    row = (
        ordered.withColumn("_pid", _pid())
        .where(F.col("_pid") == pid)
        .withColumn("_run", running)
        .where(F.col("_run") > position - starts[pid])
        .orderBy(key)
        .limit(1)
        .collect()[0]
    )
    return row[key], starts[pid] + row["_run"] - row["_n"], total


def key_at(df: DataFrame, major: str, minor: str, position_of) -> KeyAt:
    """Key of the row at ``position_of(n)`` (0-based) in (``major``, ``minor``) order.

    Works on row counts: one partial aggregate per ``major`` value, then one per ``minor``
    value of the single ``major`` that holds the position. Keys must be unique.
    """
    seen = {}

    def wanted(total):
        seen["at"] = position_of(total)
        return seen["at"]

    major_key, before, total = _locate(_row_counts(df, major), major, wanted)
    if major_key is None:
        return KeyAt(None, None, total)
    inside = _row_counts(df.where(F.col(major) == F.lit(major_key)), minor)
    minor_key, _, _ = _locate(inside, minor, lambda _: seen["at"] - before)
    return KeyAt(major_key, minor_key, total)
