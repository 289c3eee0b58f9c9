"""Moments of any date range from one pass over the rows.

Counts, sums and products of columns are additive, so one row per date holds all that a mean, a
deviation, a covariance or a least-squares fit needs. Running totals over that small table (one row per
day of the calendar) make every range a difference of two rows: folds cost nothing more, however much
they overlap. Values are taken around a pivot of their column, which keeps the differences exact for
columns that are constant or far from zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schemas import DATE
from tickloom.session import staged


def pivots(rows: DataFrame, cols: list[str]) -> list[float]:
    """Some present value of each column (0 where there is none)."""
    found = []
    for c in cols:
        one = rows.where(F.col(c).isNotNull()).select(F.col(c).cast("double")).limit(1).collect()
        found.append(float(one[0][0]) if one else 0.0)
    return found


def daily_products(rows: DataFrame, values: list[Column], date_col: str = DATE) -> DataFrame:
    """Per date the rows in which all ``values`` are present: ``n``, sums ``s<i>`` and products ``q<i>_<j>``, i <= j."""
    named = rows.select(F.col(date_col).alias(DATE), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)]).dropna()
    k = range(len(values))
    sums = [F.sum(f"v{i}").alias(f"s{i}") for i in k]
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i in k for j in k if i <= j]
    return named.groupBy(DATE).agg(F.count("*").cast("double").alias("n"), *sums, *products)


def running(daily: DataFrame) -> DataFrame:
    """Running totals of every column over the whole calendar of ``daily``, written once.

    The window has no key: its input is one row per day of the calendar, whatever the rows were.
    """
    cols = [c for c in daily.columns if c != DATE]
    held = staged(daily.where(F.col(DATE).isNotNull()), "daily-moments")
    span = held.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).where("lo IS NOT NULL")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias(DATE))
    order = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return staged(days.join(held, DATE, "left").fillna(0.0, cols).select(DATE, *[F.sum(c).over(order).alias(c) for c in cols]), "running-moments")


def range_totals(totals: DataFrame, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """``ranges`` with the totals of [start, end]: the running total at the end less that before the start."""
    cols = [c for c in totals.columns if c != DATE]
    span = totals.agg(F.min(DATE).alias("_lo"), F.max(DATE).alias("_hi"))
    # one row; ranges are a few rows per year of the calendar
    clipped = ranges.join(F.broadcast(span)).withColumn("_to", F.least(F.col(end), F.col("_hi"))).withColumn("_from", F.date_sub(F.least(F.col(start), F.date_add("_hi", 1)), 1))
    upto = totals.select(F.col(DATE).alias("_to"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    before = totals.select(F.col(DATE).alias("_from"), *[F.col(c).alias(f"_a_{c}") for c in cols])
    both = clipped.join(upto, "_to", "left").join(before, "_from", "left")
    less = [(F.coalesce(F.col(f"_b_{c}"), F.lit(0.0)) - F.coalesce(F.col(f"_a_{c}"), F.lit(0.0))).alias(c) for c in cols]
    return both.select(*ranges.columns, *less)


@dataclass(frozen=True)
class Products:
    """Moments of a few columns over one range: count, mean, and centred products."""

    n: float
    mean: np.ndarray
    centred: np.ndarray

    @classmethod
    def of(cls, row, k: int, pivot: list[float]) -> Products:
        n = row["n"]
        s = np.array([row[f"s{i}"] for i in range(k)])
        q = np.array([[row[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        if not n:
            return cls(0.0, np.zeros(k), np.zeros((k, k)))
        return cls(n, np.asarray(pivot) + s / n, q - np.outer(s, s) / n)

    def std(self) -> np.ndarray:
        """Population deviations."""
        return np.sqrt(np.maximum(np.diag(self.centred), 0.0) / max(self.n, 1.0))

    def least_squares(self, inputs: list[int], target: int) -> tuple[float, np.ndarray]:
        """Intercept and slopes of the best linear forecast of one column from others; inputs that tell nothing new get 0."""
        a, b = self.centred[np.ix_(inputs, inputs)], self.centred[inputs, target]
        slopes = np.linalg.lstsq(a, b, rcond=1e-12)[0] if inputs else np.zeros(0)
        return float(self.mean[target] - slopes @ self.mean[inputs]), slopes
