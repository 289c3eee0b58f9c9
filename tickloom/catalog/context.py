"""Context joins (C) and aggregations (D)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import views
from tickloom.catalog.base import _W, HORIZONS, LOOKBACK, needs, query, r, rlist, rs, tidy
from tickloom.operators import aggregates, dims, joins, scaler, windows
from tickloom.operators.calendar import date_bounds
from tickloom.operators.splits import date_range, fold_roles, walk_forward_ranges
from tickloom.plans.features import add_context, build_features
from tickloom.session import staged

_FEATS = ["logret_1d", "vol_30d", "hl_spread"]


def _prices(spark, sf, *cols):
    return views.prices(spark, sf).select("symbol", "date", *cols)


def _news_day(spark, sf):
    return dims.news_daily(views.news(spark, sf))


# --- C: joins ---------------------------------------------------------------------------


@query(
    "c1_join_fx",
    needs("prices", "fxret")
    + f"""SELECT symbol, date, {rs('close')}, {rs('coalesce(eur_fx_logret, 0)', 'eur_fx_logret')} FROM prices LEFT JOIN fxret USING (date)""",
)
def c1(spark, sf):
    out = joins.join_fx(_prices(spark, sf, "close"), dims.fx_log_return(views.fx_wide(spark, sf)))
    return tidy(out.select("symbol", "date", "close", "eur_fx_logret"))


@query("c1_join_fx_absent", needs("prices") + "SELECT symbol, date, CAST(0 AS DOUBLE) AS eur_fx_logret FROM prices")
def c1b(spark, sf):
    return tidy(joins.join_fx(_prices(spark, sf), None))


@query(
    "c2_join_news",
    needs("prices", "newsday")
    + f"""SELECT symbol, date, {rs('coalesce(news_sent_mean, 0)', 'news_sent_mean')}, {rs('coalesce(news_sent_max, 0)', 'news_sent_max')},
    coalesce(news_count, 0) AS news_count FROM prices LEFT JOIN newsday USING (date)""",
)
def c2(spark, sf):
    out = joins.join_news(_prices(spark, sf), _news_day(spark, sf))
    return tidy(out.select("symbol", "date", "news_sent_mean", "news_sent_max", "news_count"))


_WX = ["wx_tavg", "wx_prcp", "wx_wspd", "wx_pres"]
_ZSQ = " + ".join(f"pow(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 2)" for c in _WX)


@query(
    "c3_join_weather",
    needs("prices", "wx")
    + f"""SELECT symbol, date, {rs('coalesce(sq, 0)', 'sq')} FROM prices LEFT JOIN (SELECT date, {_ZSQ} AS sq FROM wx) USING (date)""",
)
def c3(spark, sf):
    """A full rotation keeps every date's distance from the mean; that is what is compared."""
    out = joins.join_weather(_prices(spark, sf), dims.weather_daily(views.weather(spark, sf)), 12)
    sq = sum((F.pow(c, F.lit(2)) for c in out.columns if c.startswith("wx_pca_")), F.lit(0.0))
    return tidy(out.select("symbol", "date", sq.alias("sq")))


@query(
    "c123_add_context",
    needs("prices", "fxret", "newsday", "wx")
    + f"""SELECT symbol, date, {rs('coalesce(eur_fx_logret, 0)', 'eur_fx_logret')}, {rs('coalesce(news_sent_mean, 0)', 'news_sent_mean')},
    coalesce(news_count, 0) AS news_count, {rs('coalesce(sq, 0)', 'sq')} FROM prices LEFT JOIN fxret USING (date)
    LEFT JOIN newsday USING (date) LEFT JOIN (SELECT date, {_ZSQ} AS sq FROM wx) USING (date)""",
)
def c123(spark, sf):
    out = add_context(
        _prices(spark, sf),
        dims.fx_log_return(views.fx_wide(spark, sf)),
        _news_day(spark, sf),
        dims.weather_daily(views.weather(spark, sf)),
    )
    sq = sum((F.pow(c, F.lit(2)) for c in out.columns if c.startswith("wx_pca_")), F.lit(0.0))
    return tidy(out.select("symbol", "date", "eur_fx_logret", "news_sent_mean", "news_count", sq.alias("sq")))


@query(
    "c5_restrict_dates",
    needs("wx", "news") + f"SELECT date, {rlist(*_WX)} FROM wx WHERE date IN (SELECT date FROM news)",
)
def c5(spark, sf):
    return tidy(dims.restrict_dates(dims.weather_daily(views.weather(spark, sf)), views.news(spark, sf)).select("date", *_WX))


@query("c6_assign_asset_id", needs("ticks", "ids") + f"SELECT symbol, date, {rs('close')}, asset_id FROM ticks JOIN ids USING (symbol)")
def c6(spark, sf):
    return tidy(joins.assign_asset_id(views.ticks(spark, sf).select("symbol", "date", "close")))


@query(
    "c7_as_of_row",
    needs("prices")
    + f"""SELECT symbol, date, {rs('close')}, source FROM prices WHERE date BETWEEN DATE '1998-06-01' - {LOOKBACK + 5} AND DATE '1998-06-01'
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""",
)
def c7(spark, sf):
    return tidy(joins.as_of_row(_prices(spark, sf, "close", "source"), "1998-06-01", LOOKBACK + 5))


_TRAIN, _VAL, _STEP = 365, 90, 90
_RANGES = f"""SELECT CAST(i AS INTEGER) AS fold, a - {_TRAIN} AS tr_start, a AS tr_end, a AS va_start, a + {_VAL} AS va_end FROM (
    SELECT i, lo + {_TRAIN} + CAST(i AS INTEGER) * {_STEP} AS a, hi FROM (SELECT min(date) AS lo, max(date) AS hi FROM ticks),
    (SELECT unnest(range(0, 1000)) AS i)) WHERE a + {_VAL} <= hi - 365"""


@query(
    "c8_assign_folds",
    needs("prices")
    + f"""SELECT p.symbol, p.date, f.fold, role FROM prices p JOIN (
    SELECT fold, 'train' AS role, tr_start AS s, tr_end AS e FROM ({_RANGES}) UNION ALL
    SELECT fold, 'val', va_start, va_end FROM ({_RANGES})) f ON p.date BETWEEN f.s AND f.e""",
)
def c8(spark, sf):
    p = _prices(spark, sf)
    ranges = walk_forward_ranges(date_range(p), _TRAIN, _VAL, _STEP)
    return joins.assign_folds(p, fold_roles(ranges)).select("symbol", "date", "fold", "role")


# --- D: aggregations --------------------------------------------------------------------

_OHLCV = [
    "open", "high", "low", "close", "volume", "quote_asset_volume", "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol",
    "closePctChange", "openPctChange",
]


@query("d1_daily_ohlcv", needs("prices") + f"SELECT symbol, date, source, {rlist(*_OHLCV)} FROM prices")
def d1(spark, sf):
    return tidy(views.prices(spark, sf).select("symbol", "date", "source", *_OHLCV))


@query("d2_weather_daily_mean", needs("wx") + f"SELECT date, {rlist(*_WX)} FROM wx")
def d2(spark, sf):
    return tidy(dims.weather_daily(views.weather(spark, sf)).select("date", *_WX))


_WX_MEDIAN = ", ".join(
    rs(f"median({c}::FLOAT::DOUBLE)", n)
    for c, n in (("l_quantity", "wx_tavg"), ("l_discount", "wx_prcp"), ("l_tax", "wx_wspd"), ("l_extendedprice", "wx_pres"))
)


@query("d2_weather_daily_median", f"SELECT CAST(l_shipdate AS DATE) AS date, {_WX_MEDIAN} FROM lineitem GROUP BY 1")
def d2b(spark, sf):
    return tidy(dims.weather_daily(views.weather(spark, sf), "median").select("date", *_WX))


@query("d3_news_daily", needs("newsday") + f"SELECT date, {rlist('news_sent_mean', 'news_sent_max')}, news_count FROM newsday")
def d3(spark, sf):
    return tidy(_news_day(spark, sf))


@query(
    "d4_news_sentiment_scalar",
    needs("news") + f"SELECT vec_id, date, {rs('list_avg(sentiment::DOUBLE[])', 'sentiment_scalar')} FROM news",
)
def d4(spark, sf):
    return tidy(dims.news_sentiment_scalar(views.news(spark, sf)).select("vec_id", "date", "sentiment_scalar"))


@query("d5_fx_log_return", needs("fxret") + f"SELECT date, {rs('eur_fx_logret')} FROM fxret")
def d5(spark, sf):
    return tidy(dims.fx_log_return(views.fx_wide(spark, sf)))


def _marked(spark, sf):
    lo, hi = date_bounds(views.ticks(spark, sf))
    panel = build_features(views.ticks(spark, sf), views.TICK_ORDER, [])
    return windows.label_rows(panel, LOOKBACK, _FEATS, HORIZONS, str(lo), str(hi))


def _scaler_sql(std: str) -> str:
    have = " AND ".join(f"target_{h}d IS NOT NULL" for h in HORIZONS)
    pairs = f"""SELECT b.logret_1d, b.vol_30d, b.hl_spread FROM labelled a JOIN labelled b
        ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - {LOOKBACK} AND a.rn - 1 WHERE a.rn > {LOOKBACK} AND a.have"""
    return (
        needs("targeted")
        + f""", labelled AS (SELECT symbol, rn, coalesce(logret_1d, lead(logret_1d, 1) OVER ({_W}))::FLOAT::DOUBLE AS logret_1d,
        vol_30d::FLOAT::DOUBLE AS vol_30d, hl_spread::FLOAT::DOUBLE AS hl_spread, {have} AS have FROM targeted), pairs AS ({pairs})
        """
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {rs(f'avg({c})', 'mean')}, {rs(std.format(c=c), 'std')}, count({c}) AS n FROM pairs" for c in _FEATS
        )
    )


@query("d6_fit_scaler_population", _scaler_sql("CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END"))
def d6(spark, sf):
    return tidy(scaler.fit_window_scaler(_marked(spark, sf), _FEATS, LOOKBACK, sample=False))


@query("d7_fit_scaler_online", _scaler_sql("sqrt(greatest(var_samp({c}), 1e-8))"))
def d7(spark, sf):
    return tidy(scaler.fit_window_scaler(_marked(spark, sf), _FEATS, LOOKBACK, sample=True))


@query("d8_weather_pca", needs("wx") + f"SELECT date, {rs(_ZSQ, 'sq')}, CAST(4 AS INTEGER) AS k FROM wx")
def d8(spark, sf):
    daily = dims.weather_daily(views.weather(spark, sf))
    fit = dims.fit_pca(daily, 12)
    out = dims.transform_pca(daily, fit)
    sq = sum((F.pow(n, F.lit(2)) for n in fit.names), F.lit(0.0))
    return tidy(out.select("date", sq.alias("sq"), F.lit(len(fit.names)).alias("k")))


_CENTRED = " + ".join(f"pow(embeddings[{i}]::DOUBLE - avg(embeddings[{i}]::DOUBLE) OVER (), 2)" for i in range(1, 65))


@query("d9_news_embedding_pca", needs("news") + f"SELECT vec_id, {rs(_CENTRED, 'sq')} FROM news")
def d9(spark, sf):
    """All components keep every row's distance from the mean; ``d9_news_pca_spectrum`` checks the rotation."""
    out = dims.news_embedding_pca(views.news(spark, sf))
    sq = sum((F.pow(f"news_pca_{i}", F.lit(2)) for i in range(64)), F.lit(0.0))
    return tidy(out.select("vec_id", sq.alias("sq")))


def _spectrum(components: DataFrame, names: list[str], one: DataFrame) -> DataFrame:
    """What must hold of principal components: no covariance, falling variances that add up to the data's."""
    variances = [float(v) for v in components.agg(*[F.var_pop(n) for n in names]).first()]
    together = Correlation.corr(components.select(array_to_vector(F.array(*names)).alias("v")), "v").first()[0].toArray()
    loose = float(abs(together - np.eye(len(names))).max())
    falling = all(x >= y - 1e-9 for x, y in zip(variances[:-1], variances[1:]))
    return one.select(
        F.lit(len(names)).alias("k"), F.lit(falling).alias("falling"), F.lit(loose < 1e-6).alias("uncorrelated"), F.lit(float(sum(variances))).alias("total")
    )


@query("d8_weather_pca_spectrum", needs("wx") + f"SELECT CAST(4 AS INTEGER) AS k, true AS falling, true AS uncorrelated, {rs('4.0 * count(*) / count(wx_tavg)', 'total')} FROM wx")
def d8_spectrum(spark, sf):
    """Standardised measures have a total variance of their number."""
    daily = dims.weather_daily(views.weather(spark, sf))
    fit = dims.fit_pca(daily, 12)
    return tidy(_spectrum(dims.transform_pca(daily, fit), fit.names, spark.range(1)))


_TOTAL = " + ".join(f"var_pop(embeddings[{i}]::DOUBLE)" for i in range(1, 65))


@query("d9_news_pca_spectrum", needs("news") + f"SELECT CAST(64 AS INTEGER) AS k, true AS falling, true AS uncorrelated, {rs(_TOTAL, 'total', 4)} FROM news")
def d9_spectrum(spark, sf):
    out = dims.news_embedding_pca(views.news(spark, sf))
    names = [f"news_pca_{i}" for i in range(64)]
    return _spectrum(staged(out.select(*names), "components"), names, spark.range(1)).withColumn("total", r(F.col("total"), 4))


@query("d9_news_pca_daily", needs("newsday") + f"SELECT date, {rlist('news_sent_mean')}, news_count, CAST(32 AS INTEGER) AS k FROM newsday")
def d9b(spark, sf):
    day = dims.news_daily(dims.news_embedding_pca(views.news(spark, sf), 32))
    k = len([c for c in day.columns if c.startswith("news_pca_")])
    return tidy(day.select("date", "news_sent_mean", "news_count", F.lit(k).alias("k")))


@query(
    "d10_pinball_loss",
    f"""SELECT {rs('(avg(greatest(0.5 * (value - 30), -0.5 * (value - 30))) + avg(greatest(0.9 * (value - 60), -0.1 * (value - 60)))) / 2', 'pinball')} FROM events""",
)
def d10(spark, sf):
    e = views.table(spark, sf, "events").select("value", F.lit(30.0).alias("p50"), F.lit(60.0).alias("p90"))
    return tidy(aggregates.pinball_loss(e, "value", {0.5: "p50", 0.9: "p90"}))


@query(
    "d11_smooth_l1_loss",
    f"SELECT {rs('avg(CASE WHEN abs(30 - value) < 1 THEN 0.5 * (30 - value) * (30 - value) ELSE abs(30 - value) - 0.5 END)', 'smooth_l1')} FROM events",
)
def d11(spark, sf):
    return tidy(aggregates.smooth_l1_loss(views.table(spark, sf, "events").withColumn("p", F.lit(30.0)), "value", "p"))


@query(
    "d12_non_finite_report",
    """SELECT 'v' AS "column", count(*) FILTER (WHERE event_type IN ('error', 'click')) AS n_bad,
    min(event_id) FILTER (WHERE event_type IN ('error', 'click')) AS first_event_id FROM events
    UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL), min(event_id) FILTER (WHERE value IS NULL) FROM events""",
)
def d12(spark, sf):
    t = F.col("event_type")
    v = F.when(t == "click", F.lit(float("nan"))).when(t != "error", F.col("value"))
    e = views.table(spark, sf, "events").withColumn("v", v)
    return aggregates.non_finite_report(e, ["v", "value"], ["event_id"])


@query("d13_require_finite", "SELECT event_id FROM events")
def d13(spark, sf):
    return aggregates.require_finite(views.table(spark, sf, "events"), ["value", "user_id"]).select("event_id")


@query(
    "d14_coverage_report",
    needs("prices")
    + f"""SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
    greatest(DATE '1996-01-01', min(date) + {LOOKBACK - 1}) AS label_start, least(DATE '2001-06-30', max(date) - 30) AS label_end
    FROM prices GROUP BY symbol""",
)
def d14(spark, sf):
    return aggregates.coverage_report(_prices(spark, sf), LOOKBACK, 30, "1996-01-01", "2001-06-30")


@query(
    "d15_count_samples",
    needs("targeted")
    + f"""SELECT symbol, count(*) FILTER (WHERE rn > {LOOKBACK} AND {' AND '.join(f'target_{h}d IS NOT NULL' for h in HORIZONS)} AND n_ok > 0) AS n_samples
    FROM (SELECT *, sum(CAST(is_trading_day AS INTEGER)) OVER ({_W} ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING) AS n_ok FROM targeted) GROUP BY symbol""",
)
def d15(spark, sf):
    panel = build_features(views.ticks(spark, sf), views.TICK_ORDER, HORIZONS)
    targets, masks = [f"target_{h}d" for h in HORIZONS], [f"mask_{h}d" for h in HORIZONS]
    return windows.count_samples(panel, LOOKBACK, _FEATS, targets, masks, mode="trading")


@query(
    "d16_apply_by_key",
    needs("ticks")
    + f"""SELECT symbol, date, count(*) AS n, {rs('sum(volume)', 'volume')}, {rs('arg_max(close, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice))', 'close')}
    FROM ticks GROUP BY symbol, date""",
)
def d16(spark, sf):
    # a symbol's days together: a frame per day would cost more than its rows
    def days(pdf: pd.DataFrame, n: pd.Series) -> pd.DataFrame:
        by_day = pdf.assign(n=n).groupby("date", sort=False, dropna=False)
        last = pdf.drop_duplicates("date", keep="last")
        return last[["symbol", "date"]].assign(n=by_day["n"].sum().to_numpy(), volume=by_day["volume"].sum().to_numpy(), close=last["close"])

    def partial(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return days(pdf, pd.Series(1, pdf.index))

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return days(parts, parts["n"])

    schema = "symbol string, date date, n long, volume double, close double"
    t = views.ticks(spark, sf).select("symbol", "date", "volume", "close", *views.TICK_ORDER)
    return tidy(aggregates.apply_by_key(t, ["symbol"], ["date", *views.TICK_ORDER], partial, schema, merge, schema))


