"""Daily calendar: densification, fills and trading-day handling.

Panels hold at most one row per (symbol, date), so a symbol is never longer than the calendar
(a century is 36,525 rows) whatever share of the raw ticks it had; every window below is
partitioned by symbol on such panels and all of them share one exchange and one sort.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import clamp_min, finite_or_null
from tickloom.schemas import ACTIVITY_COLS, CHANGE_COLS, DATE, EPS, PRICE_COLS, SYMBOL

def by_symbol() -> WindowSpec:
    return Window.partitionBy(SYMBOL).orderBy(DATE)


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def date_bounds(df: DataFrame) -> tuple[dt.date, dt.date]:
    """Smallest and largest date, as two driver scalars."""
    row = df.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).first()
    return row["lo"], row["hi"]


def densify_calendar(
    panel: DataFrame, bounds: tuple[dt.date, dt.date] | None = None, carry: list[str] = []
) -> DataFrame:
    """Every symbol on every day of ``bounds`` (default: the panel's own range).

    No symbols-by-dates product is joined back: each row is stretched to the day before the
    symbol's next row and only its first day keeps the measures. Columns in ``carry`` are
    per-symbol constants repeated on the added days.
    """
    lo, hi = bounds or date_bounds(panel)
    if lo is None:
        return panel
    lo_c, hi_c = F.lit(lo), F.lit(hi)
    first = F.row_number().over(by_symbol()) == 1
    follower = F.lead(DATE).over(by_symbol())
    stretched = panel.withColumns(
        {
            "_from": F.when(first, lo_c).otherwise(F.col(DATE)),
            "_to": F.coalesce(F.date_sub(follower, 1), hi_c),
        }
    )
    days = stretched.select("*", F.explode(F.sequence("_from", "_to")).alias("_day"))
    real = F.col("_day") == F.col(DATE)
    kept = {SYMBOL, DATE, *carry}
    return days.select(
        SYMBOL,
        F.col("_day").alias(DATE),
        *[F.col(c) if c in kept else F.when(real, F.col(c)).alias(c) for c in panel.columns if c not in (SYMBOL, DATE)],
    )


def ffill(panel: DataFrame, cols: list[str]) -> DataFrame:
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in cols})


def bfill(panel: DataFrame, cols: list[str]) -> DataFrame:
    """Next present value. After ``ffill`` only the leading gap is left, see ``fill_prices``.

    Walks the days backwards: a frame that runs to the end would be re-read from every row.
    """
    back = Window.partitionBy(SYMBOL).orderBy(F.col(DATE).desc())
    seen = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in cols})


def _filled(c: str):
    """Last value so far, else the symbol's first value, else 0."""
    return F.coalesce(F.last(c, ignorenulls=True).over(so_far()), F.first(c, ignorenulls=True).over(whole()), F.lit(0.0))


def fill_gaps(panel: DataFrame, cols: list[str]) -> DataFrame:
    return panel.withColumns({c: _filled(c) for c in cols})


def trading_day_flag(panel: DataFrame) -> DataFrame:
    return panel.withColumn("is_trading_day", finite_or_null("close").isNotNull())


def fill_prices(panel: DataFrame) -> DataFrame:
    """Trading flag, then filled and clamped prices, in one pass over the symbol."""
    cols = [c for c in PRICE_COLS if c in panel.columns]
    cleaned = trading_day_flag(panel).withColumns({c: finite_or_null(c).cast("double") for c in cols})
    return cleaned.withColumns({c: clamp_min(_filled(c), EPS) for c in cols})


def mask_activity(panel: DataFrame) -> DataFrame:
    """Activity is 0 where missing or not a trading day; percentage changes 0 where missing."""
    cols = {}
    for c in ACTIVITY_COLS:
        if c in panel.columns:
            cols[c] = F.when(F.col("is_trading_day"), F.coalesce(finite_or_null(c), F.lit(0.0))).otherwise(F.lit(0.0))
    for c in CHANGE_COLS:
        if c in panel.columns:
            cols[c] = F.coalesce(finite_or_null(c), F.lit(0.0))
    return panel.withColumns(cols)
