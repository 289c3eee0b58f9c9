"""Daily reduction of ticks, losses, reports and per-key functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import is_finite
from tickloom.schemas import ACTIVITY_COLS, DATE, SYMBOL

# How each column is reduced when a day holds several rows.
_RULES = {"open": "first", "high": "max", "low": "min", "close": "last", "source": "first"}
_RULES.update({c: "sum" for c in ACTIVITY_COLS})


def daily_ohlcv(df: DataFrame, order_cols: list[str], keys: list[str] = [SYMBOL, DATE]) -> DataFrame:
    """One row per (symbol, day).

    ``order_cols`` fixes what "first" and "last" mean inside a day; both skip missing values.
    Unlisted numeric columns keep their last value. All reductions have map-side partials, so
    a symbol or a day that holds a large share of the ticks never travels row by row; what
    leaves is bounded by the calendar.
    """
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*order_cols)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    aggs = []
    for c in df.columns:
        # a pure order column has no rule of its own and is used up here
        rule = _RULES.get(c) or ("last" if c in numeric and c not in order_cols else None)
        if c in keys or rule is None:
            continue
        aggs.append(_reduce(rule, c, order).alias(c))
    return df.dropna(subset=[DATE]).groupBy(*keys).agg(*aggs)


def _reduce(rule: str, c: str, order: Column) -> Column:
    if rule == "max":
        return F.max(c)
    if rule == "min":
        return F.min(c)
    if rule == "sum":
        return F.coalesce(F.sum(c), F.lit(0.0))
    present = F.when(F.col(c).isNotNull(), order)
    return F.min_by(c, present) if rule == "first" else F.max_by(c, present)


def pinball_loss(df: DataFrame, actual: str, predicted: dict[float, str]) -> DataFrame:
    """Quantile loss averaged over the quantiles; ``predicted`` maps quantile to column."""
    parts = []
    for q, c in predicted.items():
        e = F.col(actual) - F.col(c)
        parts.append(F.avg(F.greatest(F.lit(q) * e, F.lit(q - 1) * e)))
    return df.agg((sum(parts[1:], parts[0]) / F.lit(len(parts))).alias("pinball"))


def smooth_l1(e: Column) -> Column:
    return F.when(F.abs(e) < 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)


def smooth_l1_loss(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(smooth_l1(F.col(predicted) - F.col(actual))).alias("smooth_l1"))


def non_finite_report(df: DataFrame, cols: list[str], key: list[str] = [SYMBOL, DATE]) -> DataFrame:
    """Per column: how many values are missing or non-finite and the first key with one."""
    where = F.struct(*key)
    wide = df.agg(
        *[F.count_if(~is_finite(c)).alias(f"n_{i}") for i, c in enumerate(cols)],
        *[F.min(F.when(~is_finite(c), where)).alias(f"k_{i}") for i, c in enumerate(cols)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("n_bad"), F.col(f"k_{i}").alias("first"))
            for i, c in enumerate(cols)
        ]
    )
    long = wide.select(F.explode(rows).alias("r")).select("r.column", "r.n_bad", "r.first")
    return long.select("column", "n_bad", *[F.col("first").getField(k).alias(f"first_{k}") for k in key])


def require_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` itself, or an error naming the columns that hold non-finite values."""
    counts = df.agg(*[F.count_if(~is_finite(c)).alias(c) for c in cols]).first()
    bad = {c: counts[c] for c in cols if counts[c]}
    if bad:
        raise ValueError(f"non-finite values: {bad}")
    return df


def coverage_report(panel: DataFrame, lookback: int, hmax: int, start: str, end: str) -> DataFrame:
    """Rows, range and feasible label range of each symbol."""
    seen = panel.groupBy(SYMBOL).agg(F.count("*").alias("n_rows"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"))
    lo = F.greatest(F.lit(start).cast("date"), F.date_add("first_date", lookback - 1))
    hi = F.least(F.lit(end).cast("date"), F.date_sub("last_date", hmax))
    return seen.withColumns({"label_start": lo, "label_end": hi})


def _runs(batches: Iterator[pd.DataFrame], keys: list[str], limit: int | None = None) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal keys from ordered batches, cut into pieces of ``limit`` rows."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        *closed, held = [g for _, g in held.groupby(keys, sort=False, dropna=False)] or [held]
        for group in closed:
            for at in range(0, len(group), limit or len(group)):
                yield group.iloc[at : at + (limit or len(group))]
        while limit is not None and len(held) > limit:
            yield held.iloc[:limit]
            held = held.iloc[limit:]
    if held is not None and len(held):
        yield held


def _folded(pieces: Iterator[pd.DataFrame], keys: list[str], combine: Callable[[tuple, pd.DataFrame], pd.DataFrame] | None) -> Iterator[pd.DataFrame]:
    """One frame per key from its consecutive pieces; ``combine`` shrinks what is held after each of them."""
    held = None
    for piece in pieces:
        key = tuple(piece[k].iloc[0] for k in keys)
        if held is not None and key == held[0]:
            piece = pd.concat([held[1], piece], ignore_index=True)
        elif held is not None:
            yield held[1]
        held = key, combine(key, piece.reset_index(drop=True)) if combine else piece
    if held is not None:
        yield held[1]


def _packed(frames: Iterator[pd.DataFrame], numbered: bool = False, rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Small frames joined to larger ones, to pay the Arrow transfer once per many keys.

    ``numbered`` adds ``_piece``, the running number of the frame a row came from.
    """
    buffer, n, first = [], 0, 0

    def joined() -> pd.DataFrame:
        out = pd.concat(buffer, ignore_index=True)
        if numbered:
            out["_piece"] = np.repeat(np.arange(first, first + len(buffer)), [len(f) for f in buffer])
        return out

    for frame in frames:
        buffer.append(frame)
        n += max(len(frame), 1)
        if n >= rows:
            yield joined()
            buffer, n, first = [], 0, first + len(buffer)
    if buffer:
        yield joined()


def apply_by_key(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    partial: Callable[[tuple, pd.DataFrame], pd.DataFrame],
    partial_schema: T.StructType | str,
    merge: Callable[[tuple, pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    chunk_rows: int = 100_000,
    combine: Callable[[tuple, pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Hand every key's rows, in order, to a user function in two steps.

    Rows are range-partitioned on keys and order, so a key with very many rows is spread over
    several tasks. ``partial`` sees one ordered piece of at most ``chunk_rows`` rows of a key;
    ``merge`` sees all partial results of that key, in order, and returns the final rows.
    Partial results must hold the keys. Where they do not shrink by themselves, give ``combine``,
    an associative function from consecutive partial results to fewer of them: it is applied to
    pieces of ``chunk_rows`` rows as they arrive, so that no more than a piece and what it left is held.
    """
    fields = (T.StructType.fromDDL(partial_schema) if isinstance(partial_schema, str) else partial_schema).fields
    inner = T.StructType([*fields, T.StructField("_part", T.IntegerType()), T.StructField("_piece", T.LongType())])

    def key_of(pdf: pd.DataFrame) -> tuple:
        return tuple(pdf[k].iloc[0] for k in keys)

    def first_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        results = (partial(key_of(g), g.reset_index(drop=True)) for g in _runs(batches, keys, chunk_rows))
        for out in _packed(results, numbered=True):
            yield out.assign(_part=part)

    def second_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ordered_parts = (b.drop(columns=["_part", "_piece"]) for b in batches)
        whole = _folded(_runs(ordered_parts, keys, chunk_rows if combine else None), keys, combine)
        yield from _packed(merge(key_of(g), g.reset_index(drop=True)) for g in whole)

    # an explicit number keeps AQE from folding small data into one Python task
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys, *order_by).sortWithinPartitions(*keys, *order_by)
    partials = ordered.mapInPandas(first_step, inner)
    together = partials.repartition(n, *keys).sortWithinPartitions(*keys, "_part", "_piece")
    return together.mapInPandas(second_step, schema)


def apply_by_symbol(
    ticks: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, order_cols: list[str]
) -> DataFrame:
    """User function per symbol; a symbol that raises yields one row with ``error`` set.

    Ticks are first reduced to one row per day, so a group is never longer than the calendar.
    Built-in features do not use this path.
    """
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + [T.StructField("error", T.StringType())])
    names = [f.name for f in schema]

    def guarded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            result = fn(pdf.sort_values(DATE).reset_index(drop=True))[names]
            return result.assign(error=None)
        except Exception as failure:  # one bad symbol must not stop the job
            row = {n: None for n in names}
            row.update({SYMBOL: key[0], "error": f"{type(failure).__name__}: {failure}"})
            return pd.DataFrame([row])

    return daily_ohlcv(ticks, order_cols).groupBy(SYMBOL).applyInPandas(guarded, out)
