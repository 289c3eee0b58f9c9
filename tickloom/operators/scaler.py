"""Feature scaling fitted over windows without ever building or exploding them.

Row r lies in the windows of labels r+1 .. r+L, so its weight is the number of accepted labels
among the next L rows. Moments are taken once per symbol around the symbol's own first value
and then merged, which keeps them exact for constant and far-from-zero features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.calendar import by_symbol, so_far, whole
from tickloom.operators.moments import pivots, range_totals, running
from tickloom.schemas import DATE, SYMBOL, scaler_schema
from tickloom.session import staged


class NoTrainingRows(ValueError):
    """No accepted window is left to fit on."""


def window_weights(marked: DataFrame, lookback: int) -> DataFrame:
    """``_w``: in how many accepted windows (label flag ``_valid``) each row takes part."""
    label = F.col("_valid").cast("long")
    # labels among the next rows = difference of two running counts, whatever the lookback
    counted = marked.withColumns({"_seen": F.sum(label).over(so_far()), "_all": F.sum(label).over(whole())})
    until = F.coalesce(F.lead("_seen", lookback).over(by_symbol()), F.col("_all"))
    return counted.withColumn("_w", until - F.col("_seen")).drop("_seen", "_all")


def _symbol_moments(weighted: DataFrame, features: list[str]) -> DataFrame:
    pivots = {f"_p{i}": F.coalesce(F.first(F.col(c).cast("double"), True).over(whole()), F.lit(0.0)) for i, c in enumerate(features)}
    rows = weighted.withColumns(pivots).where("_w > 0")
    aggs = []
    for i, c in enumerate(features):
        off = F.col(c).cast("double") - F.col(f"_p{i}")
        w = F.when(off.isNotNull(), F.col("_w"))
        aggs += [
            F.coalesce(F.sum(w), F.lit(0)).alias(f"n{i}"),
            F.coalesce(F.sum(w * off), F.lit(0.0)).alias(f"s{i}"),
            F.coalesce(F.sum(w * off * off), F.lit(0.0)).alias(f"q{i}"),
            F.first(f"_p{i}").alias(f"p{i}"),
        ]
    sums = rows.groupBy(SYMBOL).agg(*aggs)
    out = []
    for i in range(len(features)):
        n, s, q, p = (F.col(f"{k}{i}") for k in "nsqp")
        n1 = F.greatest(n, F.lit(1))
        out += [n.alias(f"n{i}"), (p + s / n1).alias(f"m{i}"), F.greatest(q - s * s / n1, F.lit(0.0)).alias(f"v{i}")]
    return sums.select(*out)


def fit_window_scaler(
    marked: DataFrame, features: list[str], lookback: int, sample: bool = True, eps: float = 1e-8
) -> DataFrame:
    """``(feature, mean, std, n)`` over every row of every accepted window, overlaps counted.

    ``sample`` uses n-1 and floors the variance at ``eps``; otherwise the population
    deviation is taken and 0 becomes 1. The result has one row per feature.
    """
    # one row per symbol, written rather than persisted: it outlives lost executors and needs no release
    parts = staged(_symbol_moments(window_weights(marked, lookback), features), "moments")
    idx = range(len(features))
    first = parts.agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in idx],
        *[F.sum(F.col(f"n{i}") * F.col(f"m{i}")).alias(f"s{i}") for i in idx],
    ).first()
    count = [first[f"n{i}"] or 0 for i in idx]
    if not any(count):
        raise NoTrainingRows("no training window left to fit the scaler on")
    mean = [first[f"s{i}"] / count[i] if count[i] else 0.0 for i in idx]
    spread = parts.agg(
        *[F.sum(F.col(f"v{i}") + F.col(f"n{i}") * F.pow(F.col(f"m{i}") - F.lit(mean[i]), 2)).alias(f"v{i}") for i in idx]
    ).first()
    rows = []
    for i, name in enumerate(features):
        if sample:
            std = math.sqrt(max((spread[f"v{i}"] or 0.0) / max(count[i] - 1, 1), eps))
        else:
            std = math.sqrt((spread[f"v{i}"] or 0.0) / max(count[i], 1)) or 1.0
        rows.append((name, mean[i], std, count[i]))
    return marked.sparkSession.createDataFrame(rows, scaler_schema())


def fold_scalers(
    marked: DataFrame, features: list[str], lookback: int, ranges: DataFrame, start: str = "tr_start", end: str = "tr_end", sample: bool = True, eps: float = 1e-8
) -> DataFrame:
    """``(fold, feature, mean, std, n)``: ``fit_window_scaler`` for the accepted labels of every range, from one pass.

    The sums over a label's window are differences of running sums, so they cost the same for every lookback;
    per label date they become one row, and ranges of label dates are differences again. ``marked`` are the labels
    of the whole panel, without gaps between a symbol's dates; folds without labels are left out.
    """
    at = pivots(marked, features)
    off = {f"_o{i}": F.col(c).cast("double") - F.lit(at[i]) for i, c in enumerate(features)}
    rows = marked.withColumns(off)
    kinds = [(f"{k}{i}", v) for i in range(len(features)) for k, v in (("n", F.col(f"_o{i}").isNotNull().cast("double")), ("s", F.col(f"_o{i}")), ("q", F.col(f"_o{i}") * F.col(f"_o{i}")))]
    rows = rows.withColumns({f"_{name}": F.sum(F.coalesce(v, F.lit(0.0))).over(so_far()) for name, v in kinds})
    inside = {name: F.lag(f"_{name}", 1, 0.0).over(by_symbol()) - F.lag(f"_{name}", lookback + 1, 0.0).over(by_symbol()) for name, _ in kinds}
    daily = rows.withColumns(inside).where("_valid").groupBy(DATE).agg(F.count("*").cast("double").alias("labels"), *[F.sum(name).alias(name) for name, _ in kinds])
    out = []
    for row in range_totals(running(daily), ranges, start, end).where("labels > 0").collect():  # one row per fold
        for i, name in enumerate(features):
            n, s, q = row[f"n{i}"], row[f"s{i}"], row[f"q{i}"]
            spread = max(q - s * s / n, 0.0) if n else 0.0
            std = math.sqrt(max(spread / max(n - 1, 1), eps)) if sample else math.sqrt(spread / max(n, 1)) or 1.0
            out.append((row["fold"], name, at[i] + s / n if n else 0.0, std, int(n)))
    return marked.sparkSession.createDataFrame(out, "fold int, feature string, mean double, std double, n long")


def scaler_values(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and deviation per feature; the table has one row per column, never more."""
    return {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}


def apply_scaler(df: DataFrame, scaler: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Standardise the scaler's columns by plain arithmetic on constants."""
    values = scaler_values(scaler)

    def scaled(c: str) -> Column:
        mean, std = values[c]
        return (F.col(c).cast("double") - F.lit(mean)) / F.lit(max(std, floor))

    return df.withColumns({c: scaled(c) for c in values if c in df.columns})


def apply_scaler_windows(samples: DataFrame, scaler: DataFrame, features: list[str], floor: float = 1e-12) -> DataFrame:
    """Standardise the rows of the window column ``x``."""
    values = scaler_values(scaler)
    params = F.array(
        *[F.struct(F.lit(values[c][0]).alias("m"), F.lit(max(values[c][1], floor)).alias("s")) for c in features]
    )
    row = lambda r: F.zip_with(r, params, lambda v, p: ((v.cast("double") - p["m"]) / p["s"]).cast("float"))
    return samples.withColumn("x", F.transform("x", row))
