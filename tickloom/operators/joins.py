"""Joins of the panel with context tables, dense ids and as-of lookups.

Context tables hold one row per date. ``size_checked`` writes them first, so the join is chosen on
their bytes; a large table is joined by shuffle, where AQE splits a date with very many panel rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ordering import dense_index
from tickloom.operators.dims import PcaFit, fit_pca, transform_pca
from tickloom.schemas import DATE, SYMBOL
from tickloom.session import size_checked


def _left_by_date(panel: DataFrame, dim: DataFrame | None, fills: dict[str, str]) -> DataFrame:
    """Left join on date; every ``fills`` column (name -> type) is 0 where nothing matched."""
    if dim is None:
        return panel.withColumns({c: F.lit(0).cast(t) for c, t in fills.items()})
    joined = panel.join(size_checked(dim), DATE, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in fills.items()})


def _types(dim: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in dim.schema if f.name != DATE}


def join_fx(panel: DataFrame, fx: DataFrame | None) -> DataFrame:
    """``fx`` is ``(date, eur_fx_logret)``."""
    return _left_by_date(panel, fx, {"eur_fx_logret": "float"} if fx is None else _types(fx))


def join_news(panel: DataFrame, news: DataFrame | None, n_components: int = 8) -> DataFrame:
    """``news`` is the daily table; without one, zeros and ``n_components`` zero components."""
    if news is not None:
        return _left_by_date(panel, news, _types(news))
    empty = {"news_sent_mean": "float", "news_sent_max": "float", "news_count": "long"}
    empty.update({f"news_pca_{i}": "float" for i in range(n_components)})
    return _left_by_date(panel, None, empty)


def join_weather(
    panel: DataFrame, daily: DataFrame | None, n_components: int = 12, fit_dates: DataFrame | None = None, fit: PcaFit | None = None
) -> DataFrame:
    """Principal components of the daily weather, 0 on dates without any; fitted here unless a ``fit`` is given."""
    names = [f"wx_pca_{i}" for i in range(n_components)]
    if daily is None:
        return _left_by_date(panel, None, {n: "double" for n in names})
    scores = transform_pca(daily, fit or fit_pca(daily, n_components, fit_dates))
    return _left_by_date(panel, scores, _types(scores))


def asset_dimension(df: DataFrame) -> tuple[DataFrame, int]:
    """``(symbol, asset_id)`` for the sorted distinct symbols, and its size."""
    return dense_index(df, SYMBOL, "asset_id")


def assign_asset_id(df: DataFrame, dimension: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Dense id of each row's symbol; unknown symbols get 0.

    The dimension is a written table: a large one is joined by shuffle on symbol, and a panel
    already partitioned by symbol then stays where it is.
    """
    ids, _ = dimension or asset_dimension(df)
    return df.join(ids, SYMBOL, "left").withColumn("asset_id", F.coalesce("asset_id", F.lit(0)))


def as_of_row(panel: DataFrame, as_of: str, window_days: int | None = None) -> DataFrame:
    """Latest row of each symbol on or before ``as_of``, at most ``window_days`` earlier.

    A plain partial aggregate: nothing is sorted and one row per symbol is shuffled.
    """
    day = F.lit(as_of).cast("date")
    rows = panel.where(F.col(DATE) <= day)
    if window_days is not None:
        rows = rows.where(F.col(DATE) >= F.date_sub(day, window_days))
    rest = [c for c in panel.columns if c not in (SYMBOL, DATE)]
    latest = rows.groupBy(SYMBOL).agg(F.max_by(F.struct(DATE, *rest), DATE).alias("_row"))
    return latest.select(SYMBOL, "_row.*")


def assign_folds(samples: DataFrame, folds: DataFrame, date_col: str = DATE) -> DataFrame:
    """One copy of a sample per (fold, role) whose closed date range holds it.

    ``folds`` has ``fold, role, start, end``. The ranges are listed day by day, which turns
    the range join into an equi-join on date.
    """
    days = folds.select("fold", "role", F.explode(F.sequence("start", "end")).alias(date_col))
    return samples.join(size_checked(days), date_col)


__all__ = [
    "as_of_row", "asset_dimension", "assign_asset_id", "assign_folds", "join_fx", "join_news", "join_weather",
]
