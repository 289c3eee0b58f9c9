"""Time-series features, targets and windows (E), scalar functions (H), ranking (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import views
from tickloom.catalog.base import _W, CTES, HORIZONS, LOOKBACK, needs, query, r, rlist, rs, tidy
from tickloom.functions import arrays, scalars
from tickloom.operators import calendar, clean, features, rank, targets, windows
from tickloom.operators.aggregates import daily_ohlcv
from tickloom.plans.features import build_features, daily_panel, top_movers

_PRICE = ["open", "high", "low", "close"]
_FEATS = ["logret_1d", "vol_30d", "hl_spread"]
_TC, _MC = [f"target_{h}d" for h in HORIZONS], [f"mask_{h}d" for h in HORIZONS]


def _daily(spark, sf):
    return views.prices(spark, sf).select("symbol", "date", *_PRICE, "volume", "num_trades", "closePctChange", "source")


def _dense(spark, sf):
    t = views.ticks(spark, sf)
    return calendar.densify_calendar(daily_ohlcv(t, views.TICK_ORDER), calendar.date_bounds(t))


def _panel(spark, sf):
    return daily_panel(views.ticks(spark, sf), views.TICK_ORDER)


def _features(spark, sf):
    return build_features(views.ticks(spark, sf), views.TICK_ORDER, HORIZONS)


def _price_ticks(spark, sf, *prices):
    """The ticks with these prices only, so that days hold nothing that a query does not read."""
    return views.ticks(spark, sf).select("symbol", "date", *prices, *views.TICK_ORDER)


def _window_features(spark, sf):
    return build_features(_price_ticks(spark, sf, "high", "low", "close"), views.TICK_ORDER, HORIZONS)


@query("c4_densify_calendar", needs("dense") + f"SELECT symbol, date, {rlist(*_PRICE, 'volume')} FROM dense")
def c4(spark, sf):
    return tidy(_dense(spark, sf).select("symbol", "date", *_PRICE, "volume"))


@query(
    "e1_ffill",
    needs("dense")
    + f"SELECT symbol, date, {', '.join(rs(f'last_value({c} IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING)', c) for c in ('open', 'close'))} FROM dense",
)
def e1(spark, sf):
    return tidy(calendar.ffill(_dense(spark, sf), ["open", "close"]).select("symbol", "date", "open", "close"))


@query(
    "e2_bfill",
    needs("dense")
    + f"SELECT symbol, date, {rs(f'first_value(close IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'close')} FROM dense",
)
def e2(spark, sf):
    return tidy(calendar.bfill(_dense(spark, sf), ["close"]).select("symbol", "date", "close"))


@query("e2_fill_prices", needs("panel") + f"SELECT symbol, date, {rlist(*_PRICE)}, is_trading_day FROM panel")
def e2b(spark, sf):
    return tidy(calendar.fill_prices(_dense(spark, sf)).select("symbol", "date", *_PRICE, "is_trading_day"))


@query("e3_trading_day_flag", needs("dense") + "SELECT symbol, date, close IS NOT NULL AS is_trading_day FROM dense")
def e3(spark, sf):
    return calendar.trading_day_flag(_dense(spark, sf)).select("symbol", "date", "is_trading_day")


@query(
    "e4_mask_activity",
    needs("panel") + f"SELECT symbol, date, {rlist('volume', 'quote_asset_volume', 'num_trades', 'closePctChange', 'openPctChange')} FROM panel",
)
def e4(spark, sf):
    cols = ["volume", "quote_asset_volume", "num_trades", "closePctChange", "openPctChange"]
    return tidy(_panel(spark, sf).select("symbol", "date", *cols))


@query("e5_log_return", needs("rets") + f"SELECT symbol, date, {rlist('logret_1d', 'logret_7d', 'logret_30d')} FROM rets")
def e5(spark, sf):
    return tidy(features.add_returns(_panel(spark, sf)).select("symbol", "date", "logret_1d", "logret_7d", "logret_30d"))


@query(
    "e6_rolling_std",
    needs("rets")
    + f"""SELECT symbol, date, CAST(0 AS DOUBLE) AS vol_1d,
    {', '.join(rs(f'coalesce(stddev_samp(logret_1d) OVER ({_W} ROWS {k - 1} PRECEDING), 0.0)', n) for n, k in (('vol_7d', 7), ('vol_30d', 30), ('vol_20d', 20)))} FROM rets""",
)
def e6(spark, sf):
    rets = features.add_volatility(features.add_returns(_panel(spark, sf), {"1d": 1}), features.SPAN_ROWS | {"20d": 20})
    return tidy(rets.select("symbol", "date", "vol_1d", "vol_7d", "vol_30d", "vol_20d"))


@query("e7_return_change", needs("feats") + f"SELECT symbol, date, {rlist('mom_1d', 'mom_7d', 'mom_30d')} FROM feats")
def e7(spark, sf):
    rets = features.add_returns(_panel(spark, sf), {"1d": 1})
    return tidy(features.add_return_changes(rets).select("symbol", "date", "mom_1d", "mom_7d", "mom_30d"))


@query("e8_log_momentum", needs("panel") + f"SELECT symbol, date, {rs(f'coalesce(ln(close) - lag(ln(close), 63) OVER ({_W}), 0.0)', 'mom_63d')} FROM panel")
def e8(spark, sf):
    return tidy(_panel(spark, sf).withColumn("mom_63d", features.log_momentum(63)).select("symbol", "date", "mom_63d"))


@query("e9_hl_spread", needs("prices") + f"SELECT symbol, date, {rs('(high - low) / greatest(close, 1e-6)', 'hl_spread')} FROM prices")
def e9(spark, sf):
    return tidy(_daily(spark, sf).select("symbol", "date", features.hl_spread().alias("hl_spread")))


@query(
    "e10_calendar_targets",
    needs("panel")
    + "SELECT symbol, date, "
    + ", ".join(f"{rs(f'lead(ln(close), {h}) OVER ({_W}) - ln(close)', f'target_{h}d')}, CAST(lead(close, {h}) OVER ({_W}) IS NOT NULL AS INTEGER) AS mask_{h}d" for h in (7, 30, 182, 365))
    + " FROM panel",
)
def e10(spark, sf):
    hs = [7, 30, 182, 365]
    t, m = targets.target_columns(hs)
    return tidy(targets.calendar_targets(_panel(spark, sf), hs).select("symbol", "date", *t, *m))


@query(
    "e11_price_change_targets",
    needs("panel")
    + "SELECT symbol, date, "
    + ", ".join(f"{rs(f'lead(close, {h}) OVER ({_W}) - close', f'target_{h}d')}, CAST(lead(close, {h}) OVER ({_W}) IS NOT NULL AS INTEGER) AS mask_{h}d" for h in HORIZONS)
    + " FROM panel",
)
def e11(spark, sf):
    return tidy(targets.price_change_targets(_panel(spark, sf), HORIZONS).select("symbol", "date", *_TC, *_MC))


@query(
    "e12_trading_targets",
    needs("panel")
    + f"""SELECT symbol, date, {', '.join(rs(f'target_td{h}') for h in (5, 21))}, {', '.join(f'CAST(target_td{h} IS NOT NULL AS INTEGER) AS mask_td{h}' for h in (5, 21))}
    FROM (SELECT symbol, date, {', '.join(f'CASE WHEN is_trading_day THEN lead(ln(close), {h}) OVER (PARTITION BY symbol, is_trading_day ORDER BY date) - ln(close) END AS target_td{h}' for h in (5, 21))} FROM panel)""",
)
def e12(spark, sf):
    cols = ["target_td5", "target_td21", "mask_td5", "mask_td21"]
    return tidy(targets.trading_targets(_panel(spark, sf), [5, 21]).select("symbol", "date", *cols))


_ALL = [
    *_PRICE, "volume", "quote_asset_volume", "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol", "closePctChange",
    "openPctChange", "logret_1d", "logret_7d", "logret_30d", "vol_1d", "vol_7d", "vol_30d", "mom_1d", "mom_7d", "mom_30d",
    "hl_spread", *_TC,
]


@query(
    "e13_build_features",
    needs("targeted")
    + f"""SELECT symbol, date, source, is_trading_day, dow, dom, month, asset_id, {rlist(*_ALL)},
    {', '.join(f'CAST(target_{h}d IS NOT NULL AS INTEGER) AS mask_{h}d' for h in HORIZONS)} FROM targeted""",
)
def e13(spark, sf):
    return tidy(_features(spark, sf).select("symbol", "date", "source", "is_trading_day", "dow", "dom", "month", "asset_id", *_ALL, *_MC))


@query(
    "e13_build_features_long_memory",
    needs("panel", "ids")
    + f"""SELECT symbol, date, asset_id, {rlist('logret_1d', 'mom_63d')}, {rs(f'coalesce(stddev_samp(logret_1d) OVER ({_W} ROWS 19 PRECEDING), 0.0)', 'vol_20d')}
    FROM (SELECT *, coalesce(ln(close) - lag(ln(close), 1) OVER ({_W}), 0.0) AS logret_1d,
    coalesce(ln(close) - lag(ln(close), 63) OVER ({_W}), 0.0) AS mom_63d FROM panel) JOIN ids USING (symbol)""",
)
def e13b(spark, sf):
    f = build_features(views.ticks(spark, sf), views.TICK_ORDER, [], long_memory=True)
    return tidy(f.select("symbol", "date", "asset_id", "logret_1d", "mom_63d", "vol_20d"))


# --- windows ----------------------------------------------------------------------------


def _sums(df, n_features: int, n_targets: int):
    """Comparable view of window arrays: sizes, per-feature sums and the last step.

    Arrays of ``LOOKBACK`` steps, as all are here, are added up by compiled terms; longer ones step by step.
    """
    def value(v, i: int):
        return F.coalesce(F.get(v, F.lit(i)).cast("double"), F.lit(0.0))

    def added(i: int):
        return lambda acc, v: acc + value(v, i)

    def total(i: int):
        return sum((value(F.get("x", F.lit(j)), i) for j in range(LOOKBACK)), F.lit(0.0))

    marked = sum((F.when(F.get("m", F.lit(j)), 1).otherwise(0) for j in range(1, LOOKBACK)), F.when(F.get("m", F.lit(0)), 1).otherwise(0))
    short = F.size("x") <= LOOKBACK
    cols = {"n_steps": F.size("x"), "n_ok": F.when(F.size("m") <= LOOKBACK, F.when(F.col("m").isNotNull(), marked).otherwise(-1)).otherwise(F.size(F.filter("m", lambda v: v)))}
    for i in range(n_features):
        cols[f"sum_{i}"] = F.when(short & F.col("x").isNotNull(), total(i)).otherwise(F.aggregate("x", F.lit(0.0), added(i)))
        cols[f"last_{i}"] = F.get(F.try_element_at("x", F.lit(-1)), i).cast("double")
    for i in range(n_targets):
        cols[f"y_{i}"] = F.element_at("y", i + 1).cast("double")
    return tidy(df.withColumns(cols).drop("x", "m", "y"))


def _win(frame: str) -> str:
    parts = []
    for i, c in enumerate(_FEATS):
        parts.append(rs(f"coalesce(sum({c}::FLOAT::DOUBLE) OVER ({_W} {frame}), 0.0)", f"sum_{i}"))
        parts.append(rs(f"lag({c}::FLOAT, 1) OVER ({_W})", f"last_{i}"))
    return ", ".join(parts)


_FRAME = f"ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING"
_Y = ", ".join(rs(f"target_{h}d::FLOAT", f"y_{i}") for i, h in enumerate(HORIZONS))
_HAVE = " AND ".join(f"target_{h}d IS NOT NULL" for h in HORIZONS)


def _window_sql(ok: str) -> str:
    return (
        needs("targeted")
        + f"""SELECT symbol, label_date, CAST({LOOKBACK} AS INTEGER) AS n_steps, CAST(n_ok AS INTEGER) AS n_ok, asset_id,
        {', '.join(f'sum_{i}, last_{i}' for i in range(3))}, {', '.join(f'y_{i}' for i in range(2))} FROM (
        SELECT symbol, date AS label_date, rn, sum(CAST({ok} AS INTEGER)) OVER ({_W} {_FRAME}) AS n_ok,
        lag(asset_id, 1) OVER ({_W}) AS asset_id, {_win(_FRAME)}, {_Y}, {_HAVE} AS have FROM targeted)
        WHERE rn > {LOOKBACK} AND n_ok > 0 AND have"""
    )


@query("e14_lookback_windows", _window_sql("logret_1d IS NOT NULL"))
def e14(spark, sf):
    w = windows.lookback_windows(_window_features(spark, sf), LOOKBACK, _FEATS, _TC, _MC, mode="finite")
    return _sums(w, 3, 2)


@query("e15_lookback_windows_trading", _window_sql("is_trading_day"))
def e15(spark, sf):
    w = windows.lookback_windows(_window_features(spark, sf), LOOKBACK, _FEATS, _TC, _MC, mode="trading")
    return _sums(w, 3, 2)


_RANGE_SQL = (
    needs("targeted")
    + f"""SELECT symbol, label_date, CAST({LOOKBACK} AS INTEGER) AS n_steps, CAST({LOOKBACK} AS INTEGER) AS n_ok, asset_id,
    {', '.join(f'sum_{i}, last_{i}' for i in range(3))}, {', '.join(f'y_{i}' for i in range(2))} FROM (
    SELECT symbol, date AS label_date, rn, asset_id, {_win(_FRAME)}, {_Y}, {_HAVE} AS have
    FROM (SELECT * REPLACE (coalesce(logret_1d, lead(logret_1d, 1) OVER ({_W})) AS logret_1d) FROM targeted))
    WHERE rn > {LOOKBACK} AND have"""
)


@query("e16_label_range_windows", _RANGE_SQL)
def e16(spark, sf):
    lo, hi = calendar.date_bounds(views.ticks(spark, sf))
    w = windows.label_range_windows(_window_features(spark, sf), LOOKBACK, _FEATS, HORIZONS, str(lo), str(hi))
    return _sums(w, 3, 2)


@query("e14_windows_in_ranges", _window_sql("logret_1d IS NOT NULL"))
def e14_ranges(spark, sf):
    """The windows of e14 with every symbol's history in ranges of 512 rows."""
    w = windows.lookback_windows(_window_features(spark, sf), LOOKBACK, _FEATS, _TC, _MC, mode="finite", span_rows=512)
    return _sums(w, 3, 2)


@query("e16_windows_in_ranges", _RANGE_SQL)
def e16_ranges(spark, sf):
    """The windows of e16 with every symbol's history in ranges of 512 rows."""
    lo, hi = calendar.date_bounds(views.ticks(spark, sf))
    w = windows.label_range_windows(_window_features(spark, sf), LOOKBACK, _FEATS, HORIZONS, str(lo), str(hi), span_rows=512)
    return _sums(w, 3, 2)


@query(
    "e17_inference_window",
    needs("prices")
    + f"""SELECT symbol, max(date) AS label_date, CAST(0 AS INTEGER) AS asset_id, CAST({LOOKBACK} AS INTEGER) AS n_steps,
    CAST(count(*) - 1 AS INTEGER) AS n_ok,
    {rs(f'sum(CASE WHEN rn < n THEN close::FLOAT::DOUBLE ELSE 0 END) + ({LOOKBACK} - count(*) + 1) * arg_min(close::FLOAT::DOUBLE, date)', 'sum_0')},
    {rs('arg_max(close::FLOAT, date) FILTER (WHERE rn < n)', 'last_0')},
    {rs(f'sum(CASE WHEN rn < n THEN open::FLOAT::DOUBLE ELSE 0 END) + ({LOOKBACK} - count(*) + 1) * arg_min(open::FLOAT::DOUBLE, date)', 'sum_1')},
    {rs('arg_max(open::FLOAT, date) FILTER (WHERE rn < n)', 'last_1')}
    FROM (SELECT *, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM prices
    WHERE date BETWEEN DATE '2001-09-01' - {LOOKBACK + 5} AND DATE '2001-09-01') WHERE rn >= n - {LOOKBACK}
    GROUP BY symbol HAVING count(*) > 1""",
)
def e17(spark, sf):
    w = windows.inference_window(_daily(spark, sf), "2001-09-01", LOOKBACK, ["close", "open"])
    return _sums(w, 2, 0)


@query(
    "e18_last_window",
    needs("prices")
    + f"""SELECT symbol, max(date) AS label_date, CAST(0 AS INTEGER) AS asset_id, CAST({LOOKBACK} AS INTEGER) AS n_steps,
    CAST({LOOKBACK} AS INTEGER) AS n_ok, {rs('sum(close::FLOAT::DOUBLE)', 'sum_0')}, {rs('arg_max(close::FLOAT, date)', 'last_0')},
    {rs('sum(volume::FLOAT::DOUBLE)', 'sum_1')}, {rs('arg_max(volume::FLOAT, date)', 'last_1')}
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM prices) WHERE back <= {LOOKBACK}
    GROUP BY symbol HAVING count(*) = {LOOKBACK}""",
)
def e18(spark, sf):
    return _sums(windows.last_window(_daily(spark, sf), LOOKBACK, ["close", "volume"]), 2, 0)


# --- F: sorts, top-k, nearest -----------------------------------------------------------


@query("f1_cluster_panel", needs("prices") + f"SELECT symbol, date, {rs('close')} FROM prices")
def f1(spark, sf):
    return tidy(clean.cluster_panel(_daily(spark, sf).select("symbol", "date", "close")))


@query(
    "f2_top_movers",
    needs("feats")
    + f"""SELECT symbol, date, {rlist('close', 'logret_30d', 'vol_30d', 'hl_spread')} FROM feats
    WHERE date = (SELECT max(date) FROM ticks) AND logret_30d IS NOT NULL ORDER BY logret_30d DESC, symbol DESC LIMIT 25""",
)
def f2(spark, sf):
    return tidy(top_movers(views.ticks(spark, sf), views.TICK_ORDER, 25))


_GONE = "(date < (SELECT max(date) FROM base) - 31 AND date > (SELECT max(date) FROM base) - 200 AND l_orderkey % 3 > 0)"
_TICKS = CTES["ticks"][1]
_GAPPY = f"""base AS MATERIALIZED ({_TICKS}), ticks AS MATERIALIZED (SELECT symbol, date, price, CASE WHEN NOT {_GONE} THEN open END AS open, high, low,
    CASE WHEN NOT {_GONE} THEN close END AS close, volume, quote_asset_volume, num_trades, taker_buy_base_vol, taker_buy_quote_vol,
    closePctChange, openPctChange, source, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM base)"""


@query(
    "f2_top_movers_gaps",
    needs("feats").replace(f"ticks AS MATERIALIZED ({_TICKS})", _GAPPY, 1)
    + f"""SELECT symbol, date, {rlist('close', 'logret_30d', 'vol_30d', 'hl_spread')} FROM feats
    WHERE date = (SELECT max(date) FROM ticks) AND logret_30d IS NOT NULL ORDER BY logret_30d DESC, symbol DESC LIMIT 25""",
)
def f2_gaps(spark, sf):
    """Missing opens and closes before the last month: the last present ones count."""
    base = views.ticks(spark, sf)
    last = F.lit(calendar.date_bounds(base)[1])
    gone = (F.col("date") < F.date_sub(last, 31)) & (F.col("date") > F.date_sub(last, 200)) & (F.col("l_orderkey") % 3 > 0)
    ticks = base.withColumns({"open": F.when(~gone, F.col("open")), "close": F.when(~gone, F.col("close"))})
    return tidy(top_movers(ticks, views.TICK_ORDER, 25))


@query(
    "f2_top_k",
    needs("prices") + f"SELECT symbol, date, {rs('close')} FROM prices ORDER BY close DESC, symbol DESC, date DESC LIMIT 25",
)
def f2b(spark, sf):
    p = _daily(spark, sf).select("symbol", "date", "close", F.struct("symbol", "date").alias("tie"))
    return tidy(rank.top_k(p, "close", 25, "tie").drop("tie"))


_TARGETS = {"1w": 7, "1m": 30, "6m": 182, "1y": 365}


@query(
    "f4_nearest_match",
    f"""SELECT user_id, label, event_id AS idx, {rs('value')} FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY pin DESC, abs(value - target), event_id) AS k FROM (
    SELECT e.*, t.*, (label = '1y' AND event_id = 77) AS pin FROM events e CROSS JOIN
    (VALUES {', '.join(f"('{k}', {v})" for k, v in _TARGETS.items())}) t(label, target) WHERE value > 0 OR (label = '1y' AND event_id = 77))) WHERE k = 1""",
)
def f4(spark, sf):
    e = views.table(spark, sf, "events")
    return tidy(rank.nearest_match(e, "value", "event_id", _TARGETS, ["user_id"], pinned={"1y": 77}))


# --- H: scalar functions ----------------------------------------------------------------


@query("h1_safe_log", f"SELECT event_id, {rs('ln(greatest(value - 50, 1e-6))', 'v')} FROM events")
def h1(spark, sf):
    return tidy(views.table(spark, sf, "events").select("event_id", scalars.safe_log(F.col("value") - 50).alias("v")))


@query("h2_expected_price", f"SELECT event_id, {rs('CASE WHEN value - 10 > 0 THEN (value - 10) * exp(user_id / 1000.0::DOUBLE) END', 'v')} FROM events")
def h2(spark, sf):
    e = views.table(spark, sf, "events")
    return tidy(e.select("event_id", scalars.expected_price(F.col("value") - 10, F.col("user_id") / 1000.0).alias("v")))


@query("h3_simple_return", f"SELECT event_id, {rs('exp(value / 1000) - 1', 'v')} FROM events")
def h3(spark, sf):
    return tidy(views.table(spark, sf, "events").select("event_id", scalars.simple_return(F.col("value") / 1000).alias("v")))


@query(
    "h4_calendar_fields",
    "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(day(ts) AS INTEGER) AS dom, CAST(month(ts) AS INTEGER) AS month FROM events",
)
def h4(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"))
    return features.add_calendar_fields(e).drop("date")


@query(
    "h5_date_arithmetic",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 182 AS due, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS age FROM orders""",
)
def h5(spark, sf):
    day = scalars.floor_day("o_orderdate")
    start = F.lit("1995-01-01").cast("date")
    return views.table(spark, sf, "orders").select("o_orderkey", F.date_add(day, 182).alias("due"), F.datediff(day, start).alias("age"))


@query(
    "h6_clean_list",
    f"""SELECT vec_id, CAST(80 AS INTEGER) AS n, {rs('list_sum(embedding::DOUBLE[])', 'total')}, {rs('list_sum(embedding[1:8]::DOUBLE[])', 'head')},
    CAST(CASE WHEN label > 2 THEN 0 ELSE 64 END AS INTEGER) AS n_raw FROM embeddings""",
)
def h6(spark, sf):
    e = views.table(spark, sf, "embeddings")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return tidy(
        e.select(
            "vec_id",
            F.size(arrays.clean_list("embedding", 80)).alias("n"),
            total(arrays.clean_list("embedding", 80)).alias("total"),
            total(arrays.clean_list("embedding", 8)).alias("head"),
            F.size(arrays.clean_list(F.when(F.col("label") <= 2, F.col("embedding")))).alias("n_raw"),
        )
    )


@query("h10_is_finite", "SELECT event_id, event_type NOT IN ('error', 'click') AS ok FROM events")
def h10(spark, sf):
    t = F.col("event_type")
    v = F.when(t == "click", F.lit(float("inf"))).when(t != "error", F.col("value"))
    return views.table(spark, sf, "events").select("event_id", scalars.is_finite(v).alias("ok"))


@query("h11_standardise", f"SELECT event_id, {rs('(value - 30.5) / 7.25', 'z')}, {rs('(value - 30.5) / 1e-12', 'flat', 0)} FROM events")
def h11(spark, sf):
    v = F.col("value")
    return views.table(spark, sf, "events").select(
        "event_id",
        r(scalars.standardise(v, F.lit(30.5), F.lit(7.25))).alias("z"),
        r(scalars.standardise(v, F.lit(30.5), F.lit(0.0)), 0).alias("flat"),
    )
