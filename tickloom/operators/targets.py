"""Future-looking labels with 0/1 availability masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import safe_log
from tickloom.operators.calendar import by_symbol
from tickloom.schemas import DATE, SYMBOL


def target_columns(horizons: list[int]) -> tuple[list[str], list[str]]:
    return [f"target_{h}d" for h in horizons], [f"mask_{h}d" for h in horizons]


def add_masks(panel: DataFrame, targets: list[str]) -> DataFrame:
    """``mask_*`` is 1 where the target of the same name is present."""
    return panel.withColumns({t.replace("target_", "mask_", 1): F.col(t).isNotNull().cast("byte") for t in targets})


def _with_masks(panel: DataFrame, targets: dict[str, Column]) -> DataFrame:
    return add_masks(panel.withColumns(targets), list(targets))


def calendar_target_columns(horizons: list[int]) -> dict[str, Column]:
    """Log return h rows ahead, by column name."""
    now = safe_log("close")
    return {f"target_{h}d": F.lead(now, h).over(by_symbol()) - now for h in horizons}


def calendar_targets(panel: DataFrame, horizons: list[int]) -> DataFrame:
    return _with_masks(panel, calendar_target_columns(horizons))


def price_change_targets(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """Price difference h rows ahead."""
    return _with_masks(panel, {f"target_{h}d": F.lead("close", h).over(by_symbol()) - F.col("close") for h in horizons})


def trading_targets(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """Log return h trading rows ahead; other rows have no target."""
    same_kind = Window.partitionBy(SYMBOL, "is_trading_day").orderBy(DATE)
    now = safe_log("close")
    ahead = {
        f"target_td{h}": F.when(F.col("is_trading_day"), F.lead(now, h).over(same_kind) - now) for h in horizons
    }
    return _with_masks(panel, ahead)
