"""From raw tables to the feature panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.aggregates import daily_ohlcv
from tickloom.operators.calendar import date_bounds, densify_calendar, fill_prices, mask_activity, whole
from tickloom.operators.clean import prep_crypto, prep_stock
from tickloom.operators.dims import fx_log_return, news_daily, news_embedding_pca, weather_daily
from tickloom.operators.features import RETURN_LAGS, SPAN_ROWS, add_technicals, add_technicals_long
from tickloom.operators.joins import asset_dimension, assign_asset_id, join_fx, join_news, join_weather
from tickloom.operators.rank import top_k
from tickloom.operators.targets import add_masks, calendar_target_columns
from tickloom.operators.unions import union_prices
from tickloom.schemas import DATE, PRICE_COLS, SYMBOL
from tickloom.functions.scalars import is_finite
from tickloom.session import staged
from tickloom.sources.ingest import read_required


#: Rows of the dense panel that one task sorts and windows: some 60 MB.
TASK_ROWS = 250_000


def daily_panel(ticks: DataFrame, order_cols: list[str], bounds=None) -> DataFrame:
    """Dense daily panel with filled prices: duplicates reduced, calendar completed."""
    # the reduction keeps all dates and symbols, so the ticks tell its size without being reduced twice
    return dense_panel(daily_ohlcv(ticks, order_cols), bounds, ticks)


def dense_panel(daily: DataFrame, bounds=None, sized_by: DataFrame | None = None) -> DataFrame:
    """Filled prices on every day of ``bounds`` (default: the range of ``daily``), from one row per (symbol, day).

    Without ``bounds`` symbols are dealt out by the size the panel will have, so that tasks grow in number and not in
    memory: the few rows from which it is stretched do not tell. ``sized_by`` are rows with the same symbols and dates.
    """
    if bounds is None:
        rows = (daily if sized_by is None else sized_by).where(F.col(DATE).isNotNull())
        told = rows.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"), F.approx_count_distinct(SYMBOL).alias("symbols")).first()
        bounds = told["lo"], told["hi"]
        if told["lo"] is not None:
            dense = told["symbols"] * ((told["hi"] - told["lo"]).days + 1)
            daily = daily.repartition(-(-dense // TASK_ROWS) or 1, SYMBOL)
    if "source" in daily.columns:
        # constant per symbol: its first day's source, kept on the added days
        daily = daily.withColumn("source", F.first("source").over(whole()))
    dense = densify_calendar(daily, bounds, carry=["source"])
    return mask_activity(fill_prices(dense))


def build_features(
    ticks: DataFrame, order_cols: list[str], horizons: list[int] = [7, 30, 182, 365], long_memory: bool = False
) -> DataFrame:
    """The whole per-symbol feature job.

    Ticks are read once: they are reduced to a written table of days, from which the calendar,
    the asset ids and everything else come. Two shuffles of the data: that reduction (partial
    before it) and one exchange on symbol that serves densification, fills, features and targets.
    """
    daily = staged(daily_ohlcv(ticks, order_cols), "daily")
    assets = asset_dimension(daily)
    panel = dense_panel(daily)
    technicals = add_technicals_long if long_memory else add_technicals
    targets = calendar_target_columns(horizons)
    featured = add_masks(technicals(panel, targets), list(targets))
    return assign_asset_id(featured, assets)


def recent_days(ticks: DataFrame, order_cols: list[str], last: dt.date, days: int) -> DataFrame:
    """Daily rows of the final ``days`` days, and for each symbol one row on the day before them with the
    last present value of every price: what filling prices over the range needs of the history.

    The range is a filter on the date alone, so it reaches the scan. The history is read for the prices
    only and reduced by symbol and day, then by symbol, with map-side partials.
    """
    start = last - dt.timedelta(days=days)
    prices = [c for c in PRICE_COLS if c in ticks.columns]
    history = ticks.where(F.col(DATE) <= F.lit(start)).select(SYMBOL, DATE, *dict.fromkeys([*prices, *order_cols]))
    known = daily_ohlcv(history, order_cols).groupBy(SYMBOL).agg(*[F.max_by(c, F.when(is_finite(c), F.col(DATE))).alias(c) for c in prices])
    recent = daily_ohlcv(ticks.where(F.col(DATE) > F.lit(start)), order_cols)
    return recent.unionByName(known.withColumn(DATE, F.lit(start)), allowMissingColumns=True)


def top_movers(ticks: DataFrame, order_cols: list[str], k: int = 25) -> DataFrame:
    """Symbols with the largest 30-day log return on the last day, with their 30-day volatility.

    Only the last month is densified and windowed; older ticks give one row per symbol.
    """
    last = date_bounds(ticks)[1]
    days = max(RETURN_LAGS["30d"], SPAN_ROWS["30d"]) + 1
    panel = dense_panel(recent_days(ticks, order_cols, last, days), (last - dt.timedelta(days=days), last))
    latest = add_technicals(panel).where(F.col(DATE) == F.lit(last))
    ranked = top_k(latest, "logret_30d", k)
    return ranked.select(SYMBOL, DATE, "close", "logret_30d", "vol_30d", "hl_spread")


def add_context(
    panel: DataFrame,
    fx: DataFrame | None = None,
    news: DataFrame | None = None,
    weather: DataFrame | None = None,
    weather_components: int = 12,
    fit_dates: DataFrame | None = None,
) -> DataFrame:
    """Daily context joined by date; an absent table gives zeros."""
    out = join_news(join_fx(panel, fx), news)
    return join_weather(out, weather, weather_components, fit_dates)


def prep_data(
    spark: SparkSession,
    stock: str,
    crypto: str,
    fx: str,
    out: str,
    order_cols: list[str],
    horizons: list[int] = [7, 30, 182, 365],
    news: str | None = None,
    weather: str | None = None,
):
    """Staged stock, crypto, rate and (if given) news and weather tables to a stored feature panel, as one job.

    ``order_cols`` are columns of both price tables that order the rows of a day, such as the source's key.
    """
    stocks, coins = prep_stock(read_required(spark, stock), order_cols), prep_crypto(read_required(spark, crypto), order_cols)
    panel = build_features(union_prices(coins, stocks), order_cols, horizons)
    joined = join_fx(panel, fx_log_return(read_required(spark, fx)))
    if news is not None:
        joined = join_news(joined, news_daily(news_embedding_pca(read_required(spark, news))))
    if weather is not None:
        joined = join_weather(joined, weather_daily(read_required(spark, weather)))
    joined.write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.schema(joined.schema).parquet(out)


__all__ = ["add_context", "build_features", "daily_panel", "dense_panel", "prep_data", "recent_days", "top_movers"]
