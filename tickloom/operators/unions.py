"""Vertical merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_prices(first: DataFrame, second: DataFrame, fill: bool = False) -> DataFrame:
    """All rows, columns in first-seen order. ``fill`` turns missing numbers into 0."""
    both = first.unionByName(second, allowMissingColumns=True)
    if not fill:
        return both
    numeric = [f for f in both.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.IntegerType, T.LongType))]
    return both.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in numeric})


def union_panel_fx(panel: DataFrame, fx: DataFrame) -> DataFrame:
    """Compatibility mode: exchange-rate rows appended with a null symbol, not joined."""
    return union_prices(panel, fx, fill=True)


def union_folds(predictions: list[DataFrame]) -> DataFrame:
    """Append the predictions of successive folds; ``fold`` tells them apart (1-based)."""
    tagged = [p.withColumn("fold", F.lit(i)) for i, p in enumerate(predictions, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
