"""Splits, fitting and scoring (K), streaming (I) and user functions (J)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import views
from tickloom.catalog.base import _W, HORIZONS, LOOKBACK, needs, query, rlist, rs, tidy
from tickloom.catalog.context import _RANGES, _STEP, _TRAIN, _VAL
from tickloom.catalog.series import _FEATS, _MC, _TC, _price_ticks, _sums, _window_sql
from tickloom.functions import arrays
from tickloom.operators import aggregates, clean, dims, rank, scaler, splits
from tickloom.operators.calendar import date_bounds, trading_day_flag
from tickloom.operators.windows import label_rows
from tickloom.plans import jobs as pipeline_jobs
from tickloom.plans import design, pinball, scoring, tracked, training
from tickloom.plans.features import build_features, daily_panel
from tickloom.session import scratch_path, staged
from tickloom.sources import feed, ingest
from tickloom.streaming import jobs
from tickloom.streaming import windows as stream_windows
from tickloom.streaming.windows import stateful_lookback_windows


def _samples(spark, sf):
    return views.prices(spark, sf).select("symbol", F.col("date").alias("label_date"))


# --- splits -----------------------------------------------------------------------------


@query("k1_walk_forward_ranges", needs("ticks") + _RANGES)
def k1(spark, sf):
    return splits.walk_forward_ranges(splits.date_range(views.ticks(spark, sf)), _TRAIN, _VAL, _STEP)


@query(
    "k2_walk_forward_assign",
    needs("prices")
    + f""", anchors AS (SELECT CAST(i AS INTEGER) AS raw, lo + {_TRAIN} + CAST(i AS INTEGER) * {_STEP} AS a FROM
    (SELECT min(date) AS lo, max(date) AS hi FROM prices), (SELECT unnest(range(0, 1000)) AS i)
    WHERE lo + {_TRAIN} + CAST(i AS INTEGER) * {_STEP} + {_VAL} <= hi),
    hits AS (SELECT symbol, date AS label_date, raw, CASE WHEN date <= a THEN 'train' ELSE 'val' END AS role
    FROM prices JOIN anchors ON date > a - {_TRAIN} AND date <= a + {_VAL}),
    kept AS (SELECT raw, CAST(row_number() OVER (ORDER BY raw) - 1 AS INTEGER) AS fold FROM hits GROUP BY raw HAVING count(DISTINCT role) = 2)
    SELECT symbol, label_date, fold, role FROM hits JOIN kept USING (raw)""",
)
def k2(spark, sf):
    return splits.walk_forward_assign(_samples(spark, sf), _TRAIN, _VAL, _STEP).select("symbol", "label_date", "fold", "role")


def _holdout_sql(order: str) -> str:
    return needs("prices") + f"""SELECT symbol, date AS label_date,
    CASE WHEN row_number() OVER (ORDER BY {order}) > n - CAST(floor(n * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS role
    FROM prices CROSS JOIN (SELECT count(*) AS n FROM prices)"""


@query("k3_holdout_split", _holdout_sql("symbol, date"))
def k3(spark, sf):
    return splits.holdout_split(_samples(spark, sf), 0.2)


@query("k3_holdout_split_by_date", _holdout_sql("date, symbol"))
def k3b(spark, sf):
    return splits.holdout_split(_samples(spark, sf), 0.2, order="date")


# --- scaling, fitting, scoring ----------------------------------------------------------


@query(
    "k6_apply_scaler",
    needs("prices")
    + f"""SELECT symbol, date, {rs('(close - 50000.5) / 12345.25', 'close')}, {rs('(volume - 25.0) / 14.5', 'volume')} FROM prices""",
)
def k6(spark, sf):
    sc = spark.createDataFrame([("close", 50000.5, 12345.25, 1), ("volume", 25.0, 14.5, 1)], "feature string, mean double, std double, n long")
    return tidy(scaler.apply_scaler(views.prices(spark, sf).select("symbol", "date", "close", "volume"), sc))


# one input and squared errors: the fit has a closed form to compare with
_UNIT = {"logret_1d": (0.0, 1.0)}
_FIT = needs("feats") + f""", rows_ AS (SELECT symbol, date, coalesce(logret_1d, lead(logret_1d, 1) OVER ({_W}))::FLOAT::DOUBLE AS logret_1d,
    {', '.join(f'(lead(ln(close), {h}) OVER ({_W}) - ln(close))::FLOAT::DOUBLE AS y{h}' for h in HORIZONS)}, rn FROM feats),
    train AS (SELECT symbol, date, x, {', '.join(f'y{h}' for h in HORIZONS)} FROM (SELECT *, lag(logret_1d, 1) OVER ({_W}) AS x FROM rows_)
    WHERE rn > {LOOKBACK} AND y{HORIZONS[0]} IS NOT NULL AND y{HORIZONS[1]} IS NOT NULL),
    fits AS ({' UNION ALL '.join(f'SELECT CAST({h} AS INTEGER) AS horizon, regr_slope(y{h}, x) AS b, regr_intercept(y{h}, x) AS a FROM train' for h in HORIZONS)}),
    resid AS ({' UNION ALL '.join(f'SELECT horizon, y{h} - (a + b * x) AS e FROM train JOIN fits ON horizon = {h}' for h in HORIZONS)}),
    quants AS (SELECT horizon, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.9) AS p90 FROM resid GROUP BY horizon),
    newest AS (SELECT symbol, logret_1d::FLOAT::DOUBLE AS x FROM feats WHERE date = (SELECT max(date) FROM ticks))
    """


def _panel(spark, sf):
    return build_features(_price_ticks(spark, sf, "high", "low", "close"), views.TICK_ORDER, [])


def _stored_features(spark, sf, features):
    return staged(training.fit_columns(_panel(spark, sf), features), "panel")


def _fit_closed_form(spark, sf, quantiles=None):
    panel = _stored_features(spark, sf, ["logret_1d"])
    lo, hi = date_bounds(panel)
    rows, sc = training.training_rows(panel, LOOKBACK, ["logret_1d"], HORIZONS, lo, hi, _UNIT)
    fc = training.fit_point(rows, ["logret_1d"], HORIZONS, LOOKBACK, sc, loss="squaredError", inputs=["last_logret_1d"])
    return panel, training.fit_quantile(fc, rows, quantiles) if quantiles else fc


@query("k4_fit_point_squared", _FIT + f"SELECT horizon, {rs('a', 'intercept')}, {rs('b', 'slope')} FROM fits")
def k4(spark, sf):
    _, fc = _fit_closed_form(spark, sf)
    rows = [(h, float(m.intercept), float(m.coefficients[0])) for h, m in zip(fc.horizons, fc.models)]
    return tidy(spark.createDataFrame(rows, "horizon int, intercept double, slope double"))


@query("k4_fit_point_huber")
def k4b(spark, sf):
    panel = _stored_features(spark, sf, _FEATS)
    lo, hi = date_bounds(panel)
    rows, sc = training.training_rows(panel, LOOKBACK, _FEATS, HORIZONS, lo, hi)
    rows = staged(rows, "rows")  # read by the fit and by the loss
    fc = training.fit_point(rows, _FEATS, HORIZONS, LOOKBACK, sc)
    loss, n = training.validation_loss(fc, rows)
    return spark.createDataFrame([(n, loss)], "n_labels long, loss double")


@query("k5_fit_quantile", _FIT + f"SELECT horizon, {rlist('p50', 'p90')} FROM quants")
def k5(spark, sf):
    _, fc = _fit_closed_form(spark, sf, [0.5, 0.9])
    rows = [(h, fc.residual_quantiles[(h, 0.5)], fc.residual_quantiles[(h, 0.9)]) for h in fc.horizons]
    return tidy(spark.createDataFrame(rows, "horizon int, p50 double, p90 double"))


# no group of rows has a whole number of them below these: every optimum is one row's value
_PROBS = [0.1234567, 0.5432101, 0.8765433]


@query(
    "k5_fit_pinball",
    _FIT
    + f""", long AS MATERIALIZED ({' UNION ALL '.join(f'SELECT CAST({h} AS INTEGER) AS horizon, CAST(isodow(date) - 1 AS INTEGER) AS dow, y{h} AS y FROM train' for h in HORIZONS)}),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY horizon, dow ORDER BY y) AS i, count(*) OVER (PARTITION BY horizon, dow) AS n FROM long),
    best AS MATERIALIZED (SELECT horizon, prob, dow, y AS value FROM ranked CROSS JOIN (VALUES {', '.join(f'(CAST({p} AS DOUBLE))' for p in _PROBS)}) p(prob) WHERE i = ceil(n * prob)),
    losses AS (SELECT horizon, prob, avg(greatest(prob * (y - value), (prob - 1) * (y - value))) AS loss FROM long JOIN best USING (horizon, dow) GROUP BY horizon, prob)
    SELECT horizon, {rs('prob')}, dow, {rs('value')}, {rs('loss')} FROM best JOIN losses USING (horizon, prob)""",
)
def k5_pinball(spark, sf):
    """Weekdays as one-hot inputs: the optimum is every weekday's own quantile."""
    panel = _stored_features(spark, sf, ["logret_1d"])
    lo, hi = date_bounds(panel)
    rows, _ = training.training_rows(panel, LOOKBACK, ["logret_1d"], HORIZONS, lo, hi, _UNIT)
    days = [f"day_{k}" for k in range(1, 7)]
    rows = rows.withColumns({d: (F.weekday("label_date") == k + 1).cast("double") for k, d in enumerate(days)})
    models, losses, n = pinball.solve_tables(design.design_table(rows, days, len(HORIZONS)), len(days) + 1, HORIZONS, _PROBS)
    out = [(h, q, k, c[0] + (c[k] if k else 0.0), losses[(h, q)] / n) for (h, q), c in models.items() for k in range(7)]
    return tidy(spark.createDataFrame(out, "horizon int, prob double, dow int, value double, loss double"))


_EPOCHS, _CUT, _RATE, _DECAY, _PATIENCE, _DELTA = 12, "2000-01-01", 0.4, 0.001, 2, 1e-4
_HUBER = "CASE WHEN abs({0}) < 1 THEN 0.5 * ({0}) * ({0}) ELSE abs({0}) - 0.5 END"


def _tracked_sql() -> str:
    y, x, e = f"y{HORIZONS[1]}", "x", "(y - s.a - s.b * x)"
    # one damped Newton step of two coefficients an epoch; the history is cut behind the early stop
    return (
        _FIT
        + f""", rows_used AS MATERIALIZED (SELECT {x} AS x, {y} AS y, date >= DATE '{_CUT}' AS val FROM train),
    steps AS (SELECT 0 AS epoch, CAST(0.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS b
    UNION ALL SELECT epoch + 1, a + {_RATE} * ((c11 + 1e-12 + {_DECAY}) * g0 - c01 * g1) / det, b + {_RATE} * ((c00 + 1e-12) * g1 - c01 * g0) / det FROM (
    SELECT *, (c00 + 1e-12) * (c11 + 1e-12 + {_DECAY}) - c01 * c01 AS det FROM (
    SELECT s.epoch, s.a, s.b, avg(greatest(least({e}, 1.0), -1.0)) AS g0, avg(greatest(least({e}, 1.0), -1.0) * x) - {_DECAY} * s.b AS g1,
    avg(CASE WHEN abs({e}) < 1 THEN 1.0 ELSE 0.0 END) AS c00, avg(CASE WHEN abs({e}) < 1 THEN x ELSE 0.0 END) AS c01, avg(CASE WHEN abs({e}) < 1 THEN x * x ELSE 0.0 END) AS c11
    FROM steps s CROSS JOIN rows_used WHERE NOT val AND s.epoch < {_EPOCHS - 1} GROUP BY s.epoch, s.a, s.b))),
    losses AS MATERIALIZED (SELECT s.epoch, s.a, s.b, avg({_HUBER.format(e)}) FILTER (WHERE NOT val) AS train_loss, avg({_HUBER.format(e)}) FILTER (WHERE val) AS val_loss
    FROM steps s CROSS JOIN rows_used GROUP BY s.epoch, s.a, s.b),
    told AS MATERIALIZED (SELECT list(val_loss ORDER BY epoch) AS v FROM losses),
    watch AS (SELECT 0 AS epoch, v[1] AS best_loss, 0 AS best_epoch, 0 AS bad FROM told
    UNION ALL SELECT w.epoch + 1, CASE WHEN v[w.epoch + 2] < best_loss - {_DELTA} THEN v[w.epoch + 2] ELSE best_loss END,
    CASE WHEN v[w.epoch + 2] < best_loss - {_DELTA} THEN w.epoch + 1 ELSE best_epoch END, CASE WHEN v[w.epoch + 2] < best_loss - {_DELTA} THEN 0 ELSE bad + 1 END
    FROM watch w CROSS JOIN told WHERE w.epoch + 1 < {_EPOCHS} AND bad <= {_PATIENCE}),
    chosen AS (SELECT arg_max(best_epoch, epoch) AS winner FROM watch)
    SELECT l.epoch, {rs('l.train_loss', 'train_loss')}, {rs('l.val_loss', 'val_loss')}, l.epoch = winner AS best, {rs('m.a', 'intercept')}, {rs('m.b', 'slope')}
    FROM watch w JOIN losses l ON l.epoch = w.epoch CROSS JOIN chosen JOIN losses m ON m.epoch = winner"""
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("k4_fit_tracked", _tracked_sql())
def k4_tracked(spark, sf):
    """The history of the epochs, and the coefficients of the best one; half of the epochs from a resumed run."""
    panel = _stored_features(spark, sf, ["logret_1d"])
    lo, hi = date_bounds(panel)
    h = HORIZONS[1]
    rows, _ = training.training_rows(panel, LOOKBACK, ["logret_1d"], HORIZONS, lo, hi, _UNIT)
    # read for both roles and by both runs
    rows = staged(rows.select("label_date", F.slice("y", 2, 1).alias("y"), "last_logret_1d"), "labels")
    late = F.col("label_date") >= F.lit(_CUT).cast("date")
    state, args = scratch_path(spark, "fit-state"), (["logret_1d"], [h], LOOKBACK, _UNIT)
    options = {"rate": _RATE, "decay": _DECAY, "patience": _PATIENCE, "min_delta": _DELTA, "inputs": ["last_logret_1d"], "state": state}
    tracked.fit_tracked(rows.where(~late), rows.where(late), *args, epochs=_EPOCHS // 2, **options)
    fc, history = tracked.fit_tracked(rows.where(~late), rows.where(late), *args, epochs=_EPOCHS, **options)
    return tidy(history.withColumns({"intercept": F.lit(fc.linear[0][0]), "slope": F.lit(fc.linear[0][1])}))


def _score_sql(expr: str, names: list[tuple[str, str]]) -> str:
    cols = []
    for name, value in names:
        cols += [rs(value, f"pred_{name}_logret"), rs(f"exp({value}) - 1", f"pred_{name}_ret")]
    return _FIT + f"SELECT symbol, {', '.join(cols)} FROM newest {expr}"


_JOINED = " ".join(f"JOIN fits f{h} ON f{h}.horizon = {h} JOIN quants q{h} ON q{h}.horizon = {h}" for h in HORIZONS)


@query("k7_score_point", _score_sql(_JOINED, [("1w", "f7.a + f7.b * x"), ("1m", "f30.a + f30.b * x")]))
def k7(spark, sf):
    return tidy(scoring.score_point(*_fit_closed_form(spark, sf)))


@query(
    "k8_score_quantile",
    _score_sql(
        _JOINED,
        [(f"{label}_{q}", f"f{h}.a + f{h}.b * x + q{h}.{q}") for label, h in (("1w", 7), ("1m", 30)) for q in ("p50", "p90")],
    ),
)
def k8(spark, sf):
    panel, fc = _fit_closed_form(spark, sf, [0.5, 0.9])
    return tidy(scoring.score_quantile(panel, fc, [0.5, 0.9]))


@query("a11_model_round_trip", _score_sql(_JOINED, [("1w", "f7.a + f7.b * x"), ("1m", "f30.a + f30.b * x")]))
def a11_round_trip(spark, sf):
    """Scores of a model that was saved and loaded again."""
    panel, fc = _fit_closed_form(spark, sf, [0.5])
    path = scratch_path(spark, "model")
    fc.save(spark, path)
    return tidy(scoring.score_point(panel, training.Forecaster.load(spark, path)))


_H4 = [7, 30, 182, 365]
_NAMES = ["1w", "1m", "6m", "1y"]


def _table_sql(scores: str, as_of: str) -> str:
    """The 17 columns from ``symbol, price, s0 .. s3``."""
    return f"""SELECT symbol, {', '.join(rs(f's{i}', f'pred_{n}_logret') for i, n in enumerate(_NAMES))}, DATE '{as_of}' AS as_of,
    {rs('price', 'current_price')}, {rs('CASE WHEN price > 0 THEN price * exp(s3) END', 'expected_price')},
    {', '.join(rs(f'CASE WHEN price > 0 THEN price * exp(s{i}) END', f'expected_price_{n}') for i, n in enumerate(_NAMES))},
    DATE '{as_of}' + 365 AS expected_price_date, {', '.join(f"DATE '{as_of}' + {h} AS expected_price_date_{n}" for h, n in zip(_H4, _NAMES))}
    FROM ({scores})"""


_AS_OF = "2001-09-01"
_FETCHED = (
    needs("prices")
    + f""", fetched AS (SELECT *, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM prices
    WHERE date BETWEEN DATE '{_AS_OF}' - {LOOKBACK + 5} AND DATE '{_AS_OF}'),
    scored AS (SELECT symbol, open::FLOAT::DOUBLE AS price, {', '.join(f'(close::FLOAT::DOUBLE / open::FLOAT::DOUBLE - 1) * {i + 1} / 10 AS s{i}' for i in range(4))}
    FROM fetched WHERE rn = n - 1 ORDER BY s3 DESC, symbol DESC LIMIT 25) """
)


def _last(windows, i: int):
    return F.get(F.try_element_at("x", F.lit(-1)), i).cast("double")


@query("k9_score_as_of", _FETCHED + _table_sql("SELECT * FROM scored", _AS_OF))
def k9(spark, sf):
    def predict(w):
        move = _last(w, 1) / _last(w, 0) - 1
        return w.withColumns({f"pred_{i}": move * (i + 1) / 10 for i in range(4)})

    panel = views.prices(spark, sf).select("symbol", "date", "open", "close")
    return tidy(scoring.score_as_of(panel, predict, ["open", "close"], _H4, _AS_OF, LOOKBACK, 25))


@query("j5_batch_model_scoring", _FETCHED + _table_sql("SELECT * FROM scored", _AS_OF))
def j5(spark, sf):
    """The same scores from a user model fed with Arrow batches."""

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        move = pdf["x"].map(lambda x: float(x[-1][1]) / float(x[-1][0]) - 1)
        return pd.DataFrame({f"pred_{i}": move * (i + 1) / 10 for i in range(4)})

    panel = views.prices(spark, sf).select("symbol", "date", "open", "close")
    return tidy(scoring.score_as_of(panel, scoring.pandas_scorer(model, 4), ["open", "close"], _H4, _AS_OF, LOOKBACK, 25))


@query("j5_predict_batch", _FETCHED + _table_sql("SELECT * FROM scored", _AS_OF))
def j5_batch(spark, sf):
    """The same scores from a model that workers load once and feed with arrays."""

    def make():
        return lambda x: (x[:, -1, 1].astype("float64") / x[:, -1, 0] - 1)[:, None] * np.arange(1, 5) / 10

    panel = views.prices(spark, sf).select("symbol", "date", "open", "close")
    return tidy(scoring.score_as_of(panel, scoring.batch_scorer(make, LOOKBACK, 2, 4), ["open", "close"], _H4, _AS_OF, LOOKBACK, 25))


@query("k9_score_as_of_fitted")
def k9b(spark, sf):
    panel = staged(daily_panel(_price_ticks(spark, sf, "open", "close"), views.TICK_ORDER), "panel")
    lo, hi = date_bounds(panel)
    rows, sc = training.training_rows(panel, LOOKBACK, ["open", "close"], _H4, lo, hi)
    fc = training.fit_point(rows, ["open", "close"], _H4, LOOKBACK, sc)
    return scoring.score_as_of(panel, scoring.forecaster_scorer(fc), ["open", "close"], _H4, str(hi), LOOKBACK, 25)


@query("k9_predict_job")
def k9_job(spark, sf):
    """Train and predict as two jobs that share nothing but folders; the written table, read again."""
    paths = {n: scratch_path(spark, n) for n in ("panel", "model", "csv", "table")}
    daily_panel(_price_ticks(spark, sf, "open", "close"), views.TICK_ORDER).write.parquet(paths["panel"])
    last = date_bounds(spark.read.parquet(paths["panel"]))[1]
    pipeline_jobs.train(spark, paths["panel"], paths["model"], ["open", "close"], _H4, LOOKBACK, loss="squaredError")
    pipeline_jobs.predict(spark, paths["model"], paths["panel"], str(last), csv=paths["csv"], table=paths["table"])
    return tidy(spark.read.parquet(paths["table"]))


@query(
    "k12_prediction_table",
    needs("prices")
    + _table_sql(f"SELECT symbol, avg(close) AS price, {', '.join(f'max(ln(close / open)) * {i + 1} / 10 AS s{i}' for i in range(4))} FROM prices GROUP BY symbol", _AS_OF),
)
def k12(spark, sf):
    p = views.prices(spark, sf)
    move = F.max(F.ln(F.col("close") / F.col("open")))
    s = p.groupBy("symbol").agg(F.avg("close").alias("current_price"), move.alias("m"))
    items = F.array(*[F.struct(F.lit(i).alias("horizon_idx"), (F.col("m") * (i + 1) / 10).alias("logret")) for i in range(4)])
    long = s.select("symbol", "current_price", F.explode(items).alias("h")).select("symbol", "current_price", "h.*")
    return tidy(rank.prediction_table(long, _H4, _AS_OF))


@query("k13_walk_forward_evaluate")
def k13(spark, sf):
    metrics, _ = training.walk_forward_evaluate(_panel(spark, sf), _FEATS, HORIZONS, LOOKBACK, 730, 365, 365)
    return metrics


_FOLD_SQL = needs("feats", "ids") + f""", rows_ AS (SELECT symbol, date, coalesce(logret_1d, lead(logret_1d, 1) OVER ({_W}))::FLOAT::DOUBLE AS r,
    {', '.join(f'(lead(ln(close), {h}) OVER ({_W}) - ln(close))::FLOAT::DOUBLE AS y{h}' for h in HORIZONS)}, rn FROM feats),
    samples AS (SELECT symbol, date, x, {', '.join(f'y{h}' for h in HORIZONS)} FROM (SELECT *, lag(r, 1) OVER ({_W}) AS x FROM rows_)
    WHERE rn > {LOOKBACK} AND y{HORIZONS[0]} IS NOT NULL AND y{HORIZONS[1]} IS NOT NULL),
    anchors AS (SELECT CAST(row_number() OVER (ORDER BY anchor) AS INTEGER) AS fold, CAST(anchor AS DATE) AS anchor FROM (SELECT unnest(generate_series(min(date) + 730, max(date) - {max(HORIZONS)} - 365, INTERVAL 365 DAY)) AS anchor FROM feats)),
    fits AS ({' UNION ALL '.join(f'SELECT fold, CAST({h} AS INTEGER) AS horizon, regr_slope(y{h}, x) AS b, regr_intercept(y{h}, x) AS a FROM samples JOIN anchors ON date BETWEEN anchor - 730 AND anchor GROUP BY fold' for h in HORIZONS)}),
    long AS ({' UNION ALL '.join(f'SELECT symbol, date, x, CAST({h} AS INTEGER) AS horizon, y{h} AS actual FROM samples' for h in HORIZONS)})
    """


@query(
    "k13_walk_forward_predictions",
    _FOLD_SQL
    + f"""SELECT fold, symbol, date AS label_date, horizon, {rs('actual')}, {rs('a + b * x', 'predicted')} FROM long JOIN fits USING (horizon)
    JOIN anchors USING (fold) WHERE date BETWEEN anchor AND anchor + 365""",
)
def k13_predictions(spark, sf):
    """One input and squared errors: every fold has a closed form."""

    def fit(tr, features, horizons, lookback, sc):
        return training.fit_point(tr, features, horizons, lookback, sc, loss="squaredError", inputs=["last_logret_1d"])

    out = training.walk_forward_predictions(_panel(spark, sf), ["logret_1d"], HORIZONS, LOOKBACK, 730, 365, 365, fit=fit)
    return tidy(out.select("fold", "symbol", "label_date", "horizon", "actual", "predicted"))


_FOLD_DATES = f"SELECT CAST(unnest(generate_series(min(date) + 730, max(date) - {max(HORIZONS)} - 365, INTERVAL 365 DAY)) AS DATE) AS anchor FROM feats"


def _fold_ranges(panel):
    return splits.walk_forward_ranges(splits.date_range(panel), 730, 365, 365, max(HORIZONS))


@query(
    "k13_fold_scalers",
    needs("targeted")
    + f""", labelled AS MATERIALIZED (SELECT symbol, date, rn, coalesce(logret_1d, lead(logret_1d, 1) OVER ({_W}))::FLOAT::DOUBLE AS logret_1d,
    vol_30d::FLOAT::DOUBLE AS vol_30d, hl_spread::FLOAT::DOUBLE AS hl_spread, {' AND '.join(f'target_{h}d IS NOT NULL' for h in HORIZONS)} AS have FROM targeted),
    folds AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY anchor) - 1 AS INTEGER) AS fold, anchor FROM ({_FOLD_DATES})),
    pairs AS MATERIALIZED (SELECT fold, b.logret_1d, b.vol_30d, b.hl_spread FROM labelled a JOIN folds ON a.date BETWEEN anchor - 730 AND anchor
    JOIN labelled b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - {LOOKBACK} AND a.rn - 1 WHERE a.rn > {LOOKBACK} AND a.have)
    """
    + " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, {rs(f'avg({c})', 'mean')}, {rs(f'sqrt(greatest(var_samp({c}), 1e-8))', 'std')}, count({c}) AS n FROM pairs GROUP BY fold" for c in _FEATS),
)
def k13_scalers(spark, sf):
    """Every fold's scaler from one pass over the labels of the whole panel."""
    panel = _stored_features(spark, sf, _FEATS)
    lo, hi = date_bounds(panel)
    marked = staged(label_rows(panel, LOOKBACK, _FEATS, HORIZONS, str(lo), str(hi)).select("symbol", "date", *_FEATS, "_valid"), "labels")
    return tidy(scaler.fold_scalers(marked, _FEATS, LOOKBACK, _fold_ranges(panel)))


@query("k13_fold_fits", _FOLD_SQL + f"SELECT CAST(fold - 1 AS INTEGER) AS fold, horizon, {rs('a', 'intercept')}, {rs('b', 'slope')} FROM fits")
def k13_fits(spark, sf):
    """Every fold's least-squares fit from one table of daily products."""
    panel = _stored_features(spark, sf, ["logret_1d"])
    lo, hi = date_bounds(panel)
    rows = staged(training.training_rows(panel, LOOKBACK, ["logret_1d"], HORIZONS, lo, hi, _UNIT)[0], "labels")
    fits = training.fold_fits(rows, ["last_logret_1d"], HORIZONS, _fold_ranges(panel))
    return tidy(spark.createDataFrame([(f, h, c[0], c[1]) for (f, h), c in fits.items()], "fold int, horizon int, intercept double, slope double"))


@query(
    "k13_walk_forward_linear",
    _FOLD_SQL
    + f"""SELECT fold, symbol, date AS label_date, horizon, {rs('actual')}, {rs('a + b * x', 'predicted')} FROM long JOIN fits USING (horizon)
    JOIN anchors USING (fold) WHERE date BETWEEN anchor AND anchor + 365""",
)
def k13_linear(spark, sf):
    """The walk-forward forecasts again, with all folds fitted and scored together."""
    out = training.walk_forward_linear(_panel(spark, sf), ["logret_1d"], HORIZONS, LOOKBACK, 730, 365, 365, inputs=["last_logret_1d"])
    return tidy(out.select("fold", "symbol", "label_date", "horizon", "actual", "predicted"))


_WX4 = ["wx_tavg", "wx_prcp", "wx_wspd", "wx_pres"]


@query(
    "d8_fold_pca_spectrum",
    needs("wx")
    + f""", feats AS MATERIALIZED (SELECT date FROM wx), folds AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY anchor) - 1 AS INTEGER) AS fold, anchor FROM ({_FOLD_DATES}))
    SELECT fold, CAST(4 AS INTEGER) AS k, {rs('4.0')}, {rs('4.0 + 2 * (' + ' + '.join(f'pow(corr({a}, {b}), 2)' for i, a in enumerate(_WX4) for b in _WX4[i + 1:]) + ')', 'squares')}
    FROM wx JOIN folds ON date BETWEEN anchor - 730 AND anchor GROUP BY fold""".replace(" AS 4.0", " AS total"),
)
def d8_folds(spark, sf):
    """Components per fold without a refit: their variances add up to the number of measures, their squares to those of all correlations."""
    daily = staged(dims.weather_daily(views.weather(spark, sf)).select("date", *_WX4), "weather")
    ranges = _fold_ranges(daily)
    fits = dims.fold_pca(daily, 4, ranges)
    parts = []
    for f in ranges.collect():
        out = dims.transform_pca(daily.where(F.col("date").between(f["tr_start"], f["tr_end"])), fits[f["fold"]])
        spread = [F.var_pop(n) for n in fits[f["fold"]].names]
        parts.append(out.agg(F.lit(f["fold"]).alias("fold"), F.lit(len(spread)).alias("k"), sum(spread, F.lit(0.0)).alias("total"), sum((v * v for v in spread), F.lit(0.0)).alias("squares")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return tidy(whole)


# --- stored models in closed form ---------------------------------------------------------

# squared errors and one input again, with the four horizons of the prediction table
_CLOSED = (
    needs("panel")
    + f""", moves AS MATERIALIZED (SELECT symbol, date, open::FLOAT::DOUBLE AS price, close::FLOAT::DOUBLE AS c, row_number() OVER ({_W}) AS rn, lag(close::FLOAT::DOUBLE, 1) OVER ({_W}) AS x,
    {', '.join(f'(lead(ln(close::FLOAT::DOUBLE), {h}) OVER ({_W}) - ln(close::FLOAT::DOUBLE))::FLOAT::DOUBLE AS y{i}' for i, h in enumerate(_H4))} FROM panel),
    fitted AS MATERIALIZED (SELECT {', '.join(f'regr_slope(y{i}, x) AS b{i}, regr_intercept(y{i}, x) AS a{i}' for i in range(4))} FROM moves
    WHERE rn > {LOOKBACK} AND {' AND '.join(f'y{i} IS NOT NULL' for i in range(4))}),
    ends AS MATERIALIZED (SELECT max(date) AS hi FROM moves)
    """
)


def _closed_sql() -> str:
    top = f"""SELECT symbol, price, {', '.join(f'a{i} + b{i} * c AS s{i}' for i in range(4))} FROM moves CROSS JOIN fitted CROSS JOIN ends WHERE date = hi - 1 ORDER BY s3 DESC, symbol DESC LIMIT 25"""
    dates = {f"DATE '{_AS_OF}'": "(SELECT hi FROM ends)"}
    sql = _table_sql(top, _AS_OF)
    for old, new in dates.items():
        sql = sql.replace(old, new)
    return _CLOSED + sql


def _stored_panel(spark, sf):
    path = scratch_path(spark, "panel")
    daily_panel(_price_ticks(spark, sf, "open", "close"), views.TICK_ORDER).write.parquet(path)
    return path, date_bounds(spark.read.parquet(path))


@query("k9_score_as_of_closed", _closed_sql())
def k9_closed(spark, sf):
    """A forecaster fitted here, scored on the last day."""
    path, (lo, hi) = _stored_panel(spark, sf)
    panel = spark.read.parquet(path)
    rows, sc = training.training_rows(panel, LOOKBACK, ["open", "close"], _H4, lo, hi)
    fc = training.fit_point(rows, ["open", "close"], _H4, LOOKBACK, sc, loss="squaredError", inputs=["last_close"])
    return tidy(scoring.score_as_of(panel, scoring.forecaster_scorer(fc), ["open", "close"], _H4, str(hi), LOOKBACK, 25))


@query("k9_predict_job_closed", _closed_sql())
def k9_job_closed(spark, sf):
    """The same table from two jobs that share nothing but folders."""
    path, (_, hi) = _stored_panel(spark, sf)
    model, table = scratch_path(spark, "model"), scratch_path(spark, "table")
    pipeline_jobs.train(spark, path, model, ["open", "close"], _H4, LOOKBACK, loss="squaredError", inputs=["last_close"])
    pipeline_jobs.predict(spark, model, path, str(hi), table=table)
    return tidy(spark.read.parquet(table))


_NEWEST = "FROM moves CROSS JOIN fitted CROSS JOIN ends WHERE date = hi"


def _last_scores(names) -> str:
    return ", ".join(f"{rs(f'a{i} + b{i} * c', f'pred_{n}_logret')}, {rs(f'exp(a{i} + b{i} * c) - 1', f'pred_{n}_ret')}" for i, n in names)


@query("k7_score_stored_point", _CLOSED + f"SELECT symbol, {_last_scores(list(enumerate(_NAMES)))} {_NEWEST}")
def k7_stored(spark, sf):
    """Every symbol's forecast by a model that was trained as a job, kept and loaded again."""
    path, _ = _stored_panel(spark, sf)
    model = scratch_path(spark, "model")
    pipeline_jobs.train(spark, path, model, ["open", "close"], _H4, LOOKBACK, loss="squaredError", inputs=["last_close"])
    return tidy(scoring.score_point(spark.read.parquet(path), training.Forecaster.load(spark, model)))


@query(
    "k8_score_stored_quantile",
    _CLOSED
    + f""", resid AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {i} AS i, y{i} - a{i} - b{i} * x AS e FROM moves CROSS JOIN fitted WHERE rn > {LOOKBACK} AND ' + ' AND '.join(f'y{j} IS NOT NULL' for j in range(4)) for i in range(4))}),
    shifts AS MATERIALIZED (SELECT {', '.join(f'quantile_cont(e, {q}) FILTER (WHERE i = {i}) AS q{i}_{round(q * 100)}' for i in range(4) for q in (0.1, 0.9))} FROM resid)
    SELECT symbol, """
    + ", ".join(
        f"{rs(f'a{i} + b{i} * c + q{i}_{q}', f'pred_{n}_p{q}_logret')}, {rs(f'exp(a{i} + b{i} * c + q{i}_{q}) - 1', f'pred_{n}_p{q}_ret')}" for i, n in enumerate(_NAMES) for q in (10, 90)
    )
    + " FROM moves CROSS JOIN fitted CROSS JOIN ends CROSS JOIN shifts WHERE date = hi",
)
def k8_stored(spark, sf):
    """Every symbol's quantiles by a kept model with residual quantiles."""
    path, _ = _stored_panel(spark, sf)
    model = scratch_path(spark, "model")
    pipeline_jobs.train(spark, path, model, ["open", "close"], _H4, LOOKBACK, quantiles=[0.1, 0.9], loss="squaredError", inputs=["last_close"])
    return tidy(scoring.score_quantile(spark.read.parquet(path), training.Forecaster.load(spark, model), [0.1, 0.9]))


# --- I: streaming -----------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return jobs.read_files(spark, sf, schema, glob="events.parquet")


def _run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@query("i1_stream_ingest", f"SELECT event_id, CAST(ts AS DATE) AS ts, user_id, {rs('value::FLOAT', 'value')} FROM events")
def i1(spark, sf):
    schema = T.StructType.fromDDL("event_id long, ts date, user_id long, value float")
    out, ck = scratch_path(spark, "ingested"), scratch_path(spark, "ingested-ck")
    for _ in range(2):  # the second run finds nothing new
        _run(jobs.stream_ingest(_event_stream(spark, sf), schema, out, ck))
    return tidy(spark.read.schema(schema).parquet(out))


@query(
    "i1_stream_ingest_gaps",
    f"""SELECT event_id, CAST(ts AS DATE) AS date, {rs('CASE WHEN event_id % 5 > 1 THEN value END::FLOAT', 'close')}, event_id % 5 > 1 AS is_trading_day FROM events""",
)
def i1_gaps(spark, sf):
    """Missing and NaN closes pass through the stream as missing, so their days are no trading days."""
    src, out, ck = (scratch_path(spark, n) for n in ("gaps", "gaps-out", "gaps-ck"))
    schema = T.StructType.fromDDL("event_id long, date date, close float")
    close = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 > 1, F.col("value"))
    views.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"), close.alias("close")).write.parquet(src)
    stream = jobs.read_files(spark, src, T.StructType.fromDDL("event_id long, date date, close double"))
    _run(jobs.stream_ingest(stream, schema, out, ck))
    return tidy(trading_day_flag(spark.read.schema(schema).parquet(out)))


@query("i2_stateful_lookback_windows", _window_sql("is_trading_day"))
def i2(spark, sf):
    """Batch windows again, from a stream that gets the panel in four date slices."""
    panel = build_features(views.ticks(spark, sf), views.TICK_ORDER, HORIZONS)
    panel = panel.select("symbol", "date", "is_trading_day", "asset_id", *_FEATS, *_TC, *_MC)
    lo, hi = date_bounds(views.ticks(spark, sf))
    stored, src = staged(panel, "panel"), scratch_path(spark, "panel-stream")
    out, ck = scratch_path(spark, "windows"), scratch_path(spark, "windows-ck")
    quarter = (hi - lo).days // 4 + 1
    for i in range(4):
        a, b = F.date_add(F.lit(lo), i * quarter), F.date_add(F.lit(lo), (i + 1) * quarter)
        stored.where((F.col("date") >= a) & (F.col("date") < b)).write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, stored.schema)
        _run(jobs.append_parquet(stateful_lookback_windows(stream, LOOKBACK, _FEATS, _TC, _MC), out, ck))
    return _sums(spark.read.parquet(out).drop("late_rows"), 3, 2)


@query(
    "i2_late_rows",
    needs("prices")
    + """, tops AS (SELECT symbol, max(date) AS top FROM prices WHERE date < DATE '1998-03-01' GROUP BY symbol)
    SELECT symbol, date FROM prices JOIN tops USING (symbol) WHERE date >= DATE '1998-02-01' AND date <= top""",
)
def i2_late(spark, sf):
    """The second slice repeats a month of the first: its rows up to each symbol's newest are late."""
    src, out, late, ck = (scratch_path(spark, n) for n in ("late-src", "late-windows", "late-rows", "late-ck"))
    panel = views.prices(spark, sf).select("symbol", "date", "close", F.lit(True).alias("is_trading_day"), F.lit(0).alias("asset_id"), F.lit(1).alias("ok"))
    stored = staged(panel, "panel")
    for part in (stored.where("date < '1998-03-01'"), stored.where("date >= '1998-02-01'")):
        part.write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, stored.schema)
        _run(stream_windows.write_windows(stream, LOOKBACK, ["close"], ["close"], ["ok"], out, late, ck))
    return stream_windows.read_batches(spark, late)


_ID_FEED = f"SELECT event_id, user_id, event_type, {rs('value')} FROM events"


@query("a1_id_feed", _ID_FEED)
def a1_feed(spark, sf):
    """Ids in ranges read in parallel, above a mark and from the start."""
    feed.register(spark)
    e = f"{sf}/events.parquet"
    top = views.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    reader = spark.read.format("id_feed").option("path", e).option("key", "event_id").option("range_rows", 1000)
    new = reader.option("after", top // 3).load()
    known = spark.read.format("id_feed").option("path", e).option("key", "event_id").load().where(F.col("event_id") <= top // 3)
    return tidy(known.unionByName(new).select("event_id", "user_id", "event_type", "value"))


@query("i1_id_feed_stream", _ID_FEED)
def i1_feed(spark, sf):
    """A stream over ids that is stopped, gets more rows, and goes on; the third run finds nothing new."""
    feed.register(spark)
    src, out, ck = (scratch_path(spark, n) for n in ("feed-src", "feed-out", "feed-ck"))
    e = views.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    top = e.agg(F.max("event_id")).first()[0]
    for part in (e.where(F.col("event_id") <= top // 2), e.where(F.col("event_id") > top // 2), None):
        if part is not None:
            part.write.mode("append").parquet(src)
        stream = spark.readStream.format("id_feed").option("path", src).option("key", "event_id").option("range_rows", 1000).load()
        _run(jobs.append_parquet(stream, out, ck))
    return tidy(spark.read.schema(e.schema).parquet(out))


@query(
    "i3_stream_clean",
    f"""SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, {', '.join(rs('value::FLOAT', c) for c in ('open', 'close', 'high', 'low'))},
    CAST(1 AS DOUBLE) AS volume, 'stock' AS source FROM events""",
)
def i3(spark, sf):
    out, ck = scratch_path(spark, "cleaned"), scratch_path(spark, "cleaned-ck")
    stream = views.event_ticks(_event_stream(spark, sf))
    schema = clean.prep_stock(views.event_ticks(views.table(spark, sf, "events"))).schema
    _run(jobs.stream_clean(stream, clean.prep_stock, out, ck))
    return tidy(spark.read.schema(schema).parquet(out))


@query(
    "i4_stream_scaler",
    f"""SELECT 'value' AS feature, {rs('avg(value)', 'mean')}, {rs('sqrt(greatest(var_samp(value), 1e-8))', 'std')}, count(value) AS n FROM events
    UNION ALL SELECT 'user_id', {rs('avg(user_id)')}, {rs('sqrt(greatest(var_samp(user_id), 1e-8))')}, count(user_id) FROM events""".replace(" AS avg(user_id)", "").replace(" AS sqrt(greatest(var_samp(user_id), 1e-8))", ""),
)
def i4(spark, sf):
    out, ck = scratch_path(spark, "scaler"), scratch_path(spark, "scaler-ck")
    _run(jobs.stream_scaler(_event_stream(spark, sf), ["value", "user_id"], out, ck))
    return tidy(jobs.latest_scaler(spark, out))


# --- J: user functions ------------------------------------------------------------------


@query("j1_transform", f"SELECT o_orderkey, {rs('o_totalprice / 100', 'hundreds')} FROM orders")
def j1(spark, sf):
    fn = lambda df: df.select("o_orderkey", (F.col("o_totalprice") / 100).alias("hundreds"))
    return tidy(views.table(spark, sf, "orders").transform(fn))


@query(
    "j4_apply_by_symbol",
    needs("prices")
    + f"""SELECT symbol, CASE WHEN symbol LIKE '%7' THEN NULL ELSE count(*) END AS n, {rs("CASE WHEN symbol LIKE '%7' THEN NULL ELSE sum(close) END", 'total')},
    CASE WHEN symbol LIKE '%7' THEN 'ValueError: unlucky' END AS error FROM prices GROUP BY symbol""",
)
def j4(spark, sf):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["symbol"].iloc[0].endswith("7"):
            raise ValueError("unlucky")
        return pd.DataFrame([(pdf["symbol"].iloc[0], len(pdf), pdf["close"].sum())], columns=["symbol", "n", "total"])

    schema = T.StructType.fromDDL("symbol string, n long, total double")
    return tidy(aggregates.apply_by_symbol(views.ticks(spark, sf), work, schema, views.TICK_ORDER))




@query("j2_source_function", f"SELECT event_id, user_id, {rs('value::FLOAT', 'value')} FROM events")
def j2(spark, sf):
    """A source called with the stored mark, three times: all but the newest third, the rest, nothing."""
    e = views.table(spark, sf, "events")
    top = e.agg(F.max("event_id")).first()[0]
    schema = T.StructType.fromDDL("event_id long, user_id long, value float")
    path = scratch_path(spark, "source")

    def source(mark):
        fresh = ingest.ingest_incremental(e, "event_id", None if mark is None else int(mark))
        return fresh.where(F.col("event_id") <= top - top // 3) if mark is None else fresh

    for _ in range(3):
        ingest.append_staged(spark, source, "event_id", path, schema)
    return tidy(ingest.read_staged(spark, path, schema))


@query(
    "j3_list_functions",
    f"SELECT vec_id, {rs('list_avg(embedding::DOUBLE[])', 'mean')}, {rs('list_sum(embedding[1:16]::DOUBLE[])', 'head')} FROM embeddings",
)
def j3(spark, sf):
    """List columns handled element by element without any Python function."""
    total = F.aggregate(arrays.clean_list("embedding", 16), F.lit(0.0), lambda a, v: a + v.cast("double"))
    e = views.table(spark, sf, "embeddings")
    return tidy(e.select("vec_id", arrays.finite_mean("embedding").alias("mean"), total.alias("head")))
