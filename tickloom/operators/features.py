"""Per-symbol time-series features. All windows are (symbol, date) row windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import day_of_week, safe_log
from tickloom.operators.calendar import by_symbol
from tickloom.schemas import DATE, EPS, SYMBOL

# Name suffix -> row lag of the return columns (7d really is five rows).
RETURN_LAGS = {"1d": 1, "7d": 5, "30d": 30}
# Name suffix -> rows of the volatility and return-change columns.
SPAN_ROWS = {"1d": 1, "7d": 7, "30d": 30}


def log_return(k: int, price: str = "close", first: float | None = None) -> Column:
    """``ln(price)`` minus its value k rows earlier; ``first`` fills the k leading rows."""
    change = safe_log(price) - F.lag(safe_log(price), k).over(by_symbol())
    return change if first is None else F.coalesce(change, F.lit(first))


def rolling_std(col: str, k: int) -> Column:
    """Sample deviation of the last k rows; 0 with fewer than two present values."""
    if k == 1:
        return F.lit(0.0)
    return F.coalesce(F.stddev_samp(col).over(by_symbol().rowsBetween(-(k - 1), 0)), F.lit(0.0))


def rolling_stds(panel: DataFrame, col: str, spans: dict[str, int], earlier: list[Column] | None = None) -> DataFrame:
    """``panel`` with ``rolling_std(col, k)`` for every name and k of ``spans``, in two lookups of about ``sqrt(k)`` rows each.

    Count, mean and centred squares of short blocks come from the rows just before, those of a span from the blocks
    that make it up; nothing is subtracted from a running total, so a quiet span after large values stays exact.
    ``earlier`` are the values 1, 2, ... rows before, where the caller has them already.
    """
    long = {name: k for name, k in spans.items() if k > 1}
    out = panel.withColumns({name: F.lit(0.0) for name, k in spans.items() if k <= 1})
    if not long:
        return out
    block = block_rows(long.values())
    # a span is some whole blocks and, furthest back, a shorter one
    parts = {name: [(block, block * i) for i in range(k // block)] + [(k % block, k - k % block)] * (k % block > 0) for name, k in long.items()}
    sizes = sorted({size for of in parts.values() for size, _ in of})
    if earlier is None:
        out = out.withColumns({f"_e{i}": F.lag(col, i).over(by_symbol()) for i in range(1, sizes[-1])})
        earlier = [F.col(f"_e{i}") for i in range(1, sizes[-1])]
    out = out.withColumns({f"_v{i}": v.cast("double") for i, v in enumerate([F.col(col), *earlier[: sizes[-1] - 1]])})
    there = [F.col(f"_v{i}").isNotNull().cast("double") for i in range(sizes[-1])]
    out = out.withColumns({f"_n{s}_0": sum(there[1:s], there[0]) for s in sizes})
    total = [F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) for i in range(sizes[-1])]
    out = out.withColumns({f"_m{s}_0": sum(total[1:s], total[0]) / F.greatest(F.col(f"_n{s}_0"), F.lit(1.0)) for s in sizes})
    for s in sizes:
        off = [F.coalesce(F.col(f"_v{i}") - F.col(f"_m{s}_0"), F.lit(0.0)) for i in range(s)]
        out = out.withColumn(f"_q{s}_0", sum((o * o for o in off[1:]), off[0] * off[0]))
    back = {(c, s, at) for of in parts.values() for s, at in of if at for c in "nmq"}
    out = out.withColumns({f"_{c}{s}_{at}": F.lag(f"_{c}{s}_0", at, 0.0).over(by_symbol()) for c, s, at in sorted(back)})

    def added(name: str, term) -> Column:
        return sum((term(f"{s}_{at}") for s, at in parts[name][1:]), term("{}_{}".format(*parts[name][0])))

    out = out.withColumns({f"_n_{name}": added(name, lambda p: F.col(f"_n{p}")) for name in long})
    out = out.withColumns({f"_m_{name}": added(name, lambda p: F.col(f"_n{p}") * F.col(f"_m{p}")) / F.greatest(F.col(f"_n_{name}"), F.lit(1.0)) for name in long})

    def squares(name: str, p: str) -> Column:
        off = F.col(f"_m{p}") - F.col(f"_m_{name}")
        return F.col(f"_q{p}") + F.col(f"_n{p}") * off * off

    def deviation(name: str) -> Column:
        n = F.col(f"_n_{name}")
        return F.when(n > 1, F.sqrt(added(name, lambda p: squares(name, p)) / (n - 1))).otherwise(F.lit(0.0))

    found = out.withColumns({name: deviation(name) for name in long})
    return found.select(*[c for c in panel.columns if c not in spans], *spans)


def block_rows(spans) -> int:
    """Rows of a block for ``rolling_stds``; it looks up one row less before each row."""
    return math.isqrt(max(spans) - 1) + 1


def return_change(k: int, ret: str = "logret_1d") -> Column:
    """Today's one-day return minus the one k rows ago; 0 on the first k rows."""
    return F.when(F.row_number().over(by_symbol()) <= k, F.lit(0.0)).otherwise(F.col(ret) - F.lag(ret, k).over(by_symbol()))


def log_momentum(k: int = 63, price: str = "close") -> Column:
    return F.coalesce(safe_log(price) - F.lag(safe_log(price), k).over(by_symbol()), F.lit(0.0))


def hl_spread() -> Column:
    return (F.col("high") - F.col("low")) / F.greatest(F.col("close"), F.lit(EPS))


def add_returns(panel: DataFrame, lags: dict[str, int] = RETURN_LAGS) -> DataFrame:
    return panel.withColumns({f"logret_{name}": log_return(k) for name, k in lags.items()})


def add_volatility(panel: DataFrame, spans: dict[str, int] = SPAN_ROWS) -> DataFrame:
    return rolling_stds(panel, "logret_1d", {f"vol_{name}": k for name, k in spans.items()})


def add_return_changes(panel: DataFrame, spans: dict[str, int] = SPAN_ROWS) -> DataFrame:
    return panel.withColumns({f"mom_{name}": return_change(k) for name, k in spans.items()})


def add_calendar_fields(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"dow": day_of_week(DATE), "dom": F.dayofmonth(DATE), "month": F.month(DATE)})


def add_technicals(panel: DataFrame, together: dict[str, Column] = {}) -> DataFrame:
    """Returns, volatilities, return changes, spread and calendar fields.

    ``together`` are further windows over the filled prices (the targets, say): given here
    they are evaluated in the same window pass as the returns instead of one of their own.
    """
    # one pass looks up all earlier log prices; returns and their changes are differences of these
    reach = block_rows(SPAN_ROWS.values())
    steps = sorted({*range(1, reach + 1), *RETURN_LAGS.values(), *[k + i for k in SPAN_ROWS.values() for i in (0, 1)]})
    held = panel.withColumn("_l0", safe_log("close")).withColumns({**{f"_l{k}": F.lag("_l0", k).over(by_symbol()) for k in steps}, "_rn": F.row_number().over(by_symbol()), **together})

    def daily(back: int) -> Column:
        return F.col(f"_l{back}") - F.col(f"_l{back + 1}")

    returned = held.withColumns({f"logret_{name}": F.col("_l0") - F.col(f"_l{k}") for name, k in RETURN_LAGS.items()})
    changed = returned.withColumns({f"mom_{n}": F.when(F.col("_rn") <= k, F.lit(0.0)).otherwise(daily(0) - daily(k)) for n, k in SPAN_ROWS.items()} | {"hl_spread": hl_spread()})
    names = {kind: [f"{kind}_{n}" for n in of] for kind, of in (("logret", RETURN_LAGS), ("vol", SPAN_ROWS), ("mom", SPAN_ROWS))}
    spread = rolling_stds(changed, "logret_1d", dict(zip(names["vol"], SPAN_ROWS.values())), [daily(i) for i in range(1, reach)])
    made = [*names["logret"], *together, *names["vol"], *names["mom"], "hl_spread"]
    return add_calendar_fields(spread.select(*[c for c in panel.columns if c not in made], *made))


def add_technicals_long(panel: DataFrame, together: dict[str, Column] = {}) -> DataFrame:
    """The longer-memory set: first return 0, 20-row volatility, 63-row momentum."""
    base = panel.withColumns({"logret_1d": log_return(1, first=0.0), "mom_63d": log_momentum(63), **together})
    more = rolling_stds(base, "logret_1d", {"vol_20d": 20}).withColumn("hl_spread", hl_spread())
    return add_calendar_fields(more)


__all__ = [
    "RETURN_LAGS", "SPAN_ROWS", "SYMBOL", "add_calendar_fields", "add_return_changes", "add_returns",
    "add_technicals", "add_technicals_long", "add_volatility", "hl_spread", "log_momentum", "log_return",
    "return_change", "rolling_std", "rolling_stds",
]
