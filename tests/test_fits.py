import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import FLAT, planted
from tickloom.operators import dims, moments, splits
from tickloom.operators.scaler import NoTrainingRows, fit_window_scaler, fold_scalers, scaler_values
from tickloom.operators.windows import label_rows
from tickloom.plans import jobs, pinball, scoring, tracked, training

D = dt.date


def table(spark, x, y):
    rows = [(*map(float, a), [float(v) for v in np.atleast_1d(b)]) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", y array<double>").repartition(3)


def loss_of(x, y, c, q):
    return float(pinball.pinball(y - c[0] - x @ np.array(c[1:]), q).sum())


def best_loss(x, y, q):
    """The least loss of all fits that pass through as many rows as there are coefficients."""
    a, found = np.c_[np.ones(len(x)), x], np.inf
    for rows in itertools.combinations(range(len(x)), a.shape[1]):
        part = a[list(rows)]
        if abs(np.linalg.det(part)) > 1e-9:
            found = min(found, loss_of(x, y, np.linalg.solve(part, y[list(rows)]), q))
    return found


def test_pinball_fit_equals_exhaustive_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(24, 2))
    y = np.c_[x @ [1.0, -2.0] + rng.standard_t(2, size=24), rng.integers(0, 4, 24)]  # the second has many ties
    fits = pinball.fit_pinball(table(spark, x, y), ["x0", "x1"], [1, 2], [0.1, 0.5, 0.93])
    for (h, q), c in fits.items():
        assert loss_of(x, y[:, h - 1], c, q) == pytest.approx(best_loss(x, y[:, h - 1], q), rel=1e-9)


def test_pinball_fit_beyond_the_rows_decided_exactly(spark, monkeypatch):
    monkeypatch.setattr(pinball, "NEAR_ROWS", 64)
    rng = np.random.default_rng(5)
    group = rng.choice(4, 6000, p=[0.9, 0.05, 0.03, 0.02])  # one group holds nearly all rows
    x = np.eye(4)[group][:, 1:]
    y = rng.normal(size=6000) * (1 + group) + 1000 * group
    fits = pinball.fit_pinball(table(spark, x, y), ["x0", "x1", "x2"], [1], [0.0543, 0.5, 0.987])
    for (_, q), c in fits.items():
        best = sum(loss_of(np.zeros((len(v), 0)), v, [np.sort(v)[int(np.ceil(len(v) * q)) - 1]], q) for v in (y[group == g] for g in range(4)))
        assert loss_of(x, y, c, q) == pytest.approx(best, rel=1e-6)


def test_pinball_fit_of_odd_rows(spark):
    rows = [(1.0, [2.0]), (1.0, [2.0]), (None, [9.0]), (float("nan"), [9.0]), (1.0, [None]), (1.0, [float("inf")]), (1.0, None), (1.0, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "x double, y array<double>")
    c = pinball.fit_pinball(df, ["x"], [7], [0.5])[(7, 0.5)]  # a constant input and two equal rows
    assert c[0] + c[1] == pytest.approx(2.0)
    with pytest.raises(ValueError, match="no usable row"):
        pinball.fit_pinball(df.where("x IS NULL"), ["x"], [7], [0.5])


def test_pinball_fit_with_many_equal_targets(spark, monkeypatch):
    """A fifth of the rows of each group has one target, at which the quantile lies: more rows than are decided exactly."""
    monkeypatch.setattr(pinball, "NEAR_ROWS", 64)
    rng = np.random.default_rng(9)
    group, y = rng.integers(0, 7, 20000), rng.normal(size=20000) / 2
    y[rng.random(20000) < 0.186] = 0.0
    x = np.eye(7)[group][:, 1:]
    names = [f"x{i}" for i in range(6)]
    for q in (0.5432, 0.45):
        c = pinball.fit_pinball(table(spark, x, y), names, [1], [q])[(1, q)]
        best = sum(loss_of(np.zeros((len(v), 0)), v, [np.sort(v)[int(np.ceil(len(v) * q)) - 1]], q) for v in (y[group == g] for g in range(7)))
        assert loss_of(x, y, c, q) == pytest.approx(best, rel=1e-9)


def test_pinball_fit_shuffles_no_rows(spark, tmp_path):
    """What a step shuffles are its sums and a task's nearest rows, however many different rows there are."""
    from tickloom.plans import design

    rng = np.random.default_rng(10)
    x = rng.normal(size=(9000, 2))
    stored = design.design_table(table(spark, x, x @ [1.0, 2.0] + rng.normal(size=9000)), ["x0", "x1"], 1)
    near = pinball._nearest(stored, np.array([[0.0, 1.0, 2.0]]), np.array([0]), [None], 1)
    assert len(near) == 1 and near[0][2].sum() == len(near[0][0]) == pinball.NEAR_ROWS
    assert stored.columns == ["block"] and stored.count() < 9000 / 100


def test_quantile_models_keep_their_order_and_rank(spark, tmp_path):
    panel = planted(spark).withColumn("close", F.col("close") * F.when(F.col("symbol") == "s1", 1 + F.dayofyear("date") % 2 * 0.2).otherwise(1.0))
    panel.write.parquet(str(tmp_path / "panel"))
    jobs.train(spark, str(tmp_path / "panel"), str(tmp_path / "model"), ["open", "close"], [1, 2], 3, quantiles=[0.9, 0.1, 0.5], quantile_method="pinball")
    fc = training.Forecaster.load(spark, str(tmp_path / "model"))
    assert set(fc.quantile_models) == {(h, q) for h in (1, 2) for q in (0.1, 0.5, 0.9)}
    # far from the training rows fitted quantiles cross; forecasts do not
    far = spark.createDataFrame([(float(v),) * 4 for v in range(-40, 41, 8)], ", ".join(f"{c} double" for c in fc.inputs()))
    for r in fc.predict_quantiles(far, [0.5, 0.1, 0.9]).collect():
        assert all(r[f"pred_{i}_p10"] <= r[f"pred_{i}_p50"] <= r[f"pred_{i}_p90"] for i in (0, 1))
    shown = scoring.score_quantile(spark.read.parquet(str(tmp_path / "panel")), fc, [0.1, 0.9])
    assert shown.columns[1:3] == ["pred_1d_p10_logret", "pred_1d_p10_ret"] and shown.count() == 4
    high, point = (jobs.predict(spark, str(tmp_path / "model"), str(tmp_path / "panel"), "2021-01-20", quantile=q).collect() for q in (0.9, None))
    of_point = {r["symbol"]: r["pred_1y_logret"] for r in point}
    assert len(high) == 4 and all(r["pred_1y_logret"] > of_point[r["symbol"]] for r in high)
    ranked = [r["pred_1y_logret"] for r in high]
    assert ranked == sorted(ranked, reverse=True) and [r["symbol"] for r in high] != [r["symbol"] for r in point]
    only = jobs.predict(spark, str(tmp_path / "model"), str(tmp_path / "panel"), "2021-01-20", quantile=0.1, symbols=spark.createDataFrame([("s2",), ("s2",), (None,)], "symbol string"))
    assert [r["symbol"] for r in only.collect()] == ["s2"]
    with pytest.raises(ValueError, match="unknown method"):
        training.fit_quantile(fc, far, [0.5], "other")


@pytest.fixture(scope="module")
def split(spark):
    # a signal ten times as strong, so that losses are far from the least difference
    panel = planted(spark, 200)
    rows, _ = training.training_rows(panel, 3, ["x"], [1], "2020-01-01", "2020-07-01", FLAT)
    rows = rows.withColumn("y", F.transform("y", lambda v: v * 100)).cache()
    late = F.col("label_date") >= "2020-05-01"
    yield rows.where(~late), rows.where(late)
    rows.unpersist()


def fit(split, **options):
    return tracked.fit_tracked(*split, ["x"], [1], 3, FLAT, inputs=["last_x"], **options)


def test_tracked_fit_follows_the_signal(split):
    fc, history = fit(split, epochs=25, decay=0.0)
    rows = history.orderBy("epoch").collect()
    losses = [r["val_loss"] for r in rows]
    assert all(a > b for a, b in zip(losses, losses[1:5])) and rows[0]["train_loss"] > 10 * rows[-1]["train_loss"]
    assert fc.linear[0][1] == pytest.approx(50, rel=0.05)
    best = [r for r in rows if r["best"]]
    loss, _ = training.validation_loss(fc, split[1])
    assert len(best) == 1 and loss == pytest.approx(best[0]["val_loss"], rel=1e-9)


def test_tracked_fit_keeps_the_best_epoch_and_stops(spark, split):
    # validation rows that contradict the training rows: nothing beats the first epoch
    against = split[1].withColumn("y", F.transform("y", lambda v: -v))
    fc, history = fit((split[0], against), epochs=20, patience=1)
    rows = history.orderBy("epoch").collect()
    assert len(rows) == 3 and [r["best"] for r in rows] == [True, False, False] and fc.linear == [[0.0, 0.0]]
    fc, history = fit((split[0], split[1].limit(0)), epochs=4)
    rows = history.orderBy("epoch").collect()
    assert [r["val_loss"] for r in rows] == [None] * 4 and [r["best"] for r in rows] == [False] * 3 + [True]
    with pytest.raises(NoTrainingRows):
        fit((split[0].limit(0), split[1]))


def test_tracked_fit_goes_on_where_it_stopped(spark, split, tmp_path):
    fc, history = fit(split, epochs=6)
    state = str(tmp_path / "state")
    fit(split, epochs=2, state=state)
    (tmp_path / "state" / "epoch=9").mkdir()  # an epoch that was being written
    again, resumed = fit(split, epochs=6, state=state)
    assert again.linear == fc.linear and resumed.collect() == history.collect()
    fc.save(spark, str(tmp_path / "model"))
    assert training.Forecaster.load(spark, str(tmp_path / "model")).linear == fc.linear


def sparse_panel(spark):
    panel = planted(spark, 260, 3)
    return panel.withColumns({"k": F.lit(7.0), "x": F.when(F.col("symbol") != "s2", F.col("x") + 1000)})


def test_fold_scalers_equal_a_refit(spark):
    panel = sparse_panel(spark)
    ranges = splits.walk_forward_ranges(splits.date_range(panel), 90, 30, 45, 5)
    marked = label_rows(panel, 4, ["x", "k"], [1, 5], "2020-01-01", "2020-12-31").cache()
    got = {(r["fold"], r["feature"]): (r["mean"], r["std"], r["n"]) for r in fold_scalers(marked, ["x", "k"], 4, ranges).collect()}
    folds = ranges.collect()
    assert len(folds) > 2 and len(got) == 2 * len(folds)
    for f in folds:
        part = marked.withColumn("_valid", F.col("_valid") & F.col("date").between(f["tr_start"], f["tr_end"]))
        for r in fit_window_scaler(part, ["x", "k"], 4).collect():
            mean, std, n = got[(f["fold"], r["feature"])]
            assert (mean, std, n) == (pytest.approx(r["mean"], rel=1e-12), pytest.approx(r["std"], rel=1e-9), r["n"])
    none = fold_scalers(marked.where("false"), ["x"], 4, ranges)
    assert none.count() == 0 and fold_scalers(marked, ["x"], 4, ranges.where("false")).count() == 0
    marked.unpersist()


def test_ranges_outside_the_calendar_are_empty(spark):
    rows = spark.createDataFrame([(D(2020, 1, 5), 2.0), (D(2020, 1, 5), None), (D(2020, 1, 7), 3.0), (None, 1.0)], "date date, v double")
    totals = moments.running(moments.daily_products(rows, [F.col("v")]))
    spans = [(0, D(2019, 1, 1), D(2019, 2, 1)), (1, D(2019, 1, 1), D(2020, 1, 5)), (2, D(2020, 1, 6), D(2020, 1, 6)), (3, D(2020, 1, 1), D(2021, 1, 1)), (4, D(2021, 1, 1), D(2021, 2, 1))]
    ranges = spark.createDataFrame(spans, "fold int, a date, b date")
    got = {r["fold"]: (r["n"], r["s0"], r["q0_0"]) for r in moments.range_totals(totals, ranges, "a", "b").collect()}
    assert got == {0: (0, 0, 0), 1: (1, 2, 4), 2: (0, 0, 0), 3: (2, 5, 13), 4: (0, 0, 0)}
    assert moments.range_totals(moments.running(moments.daily_products(rows.limit(0), [F.col("v")])), ranges, "a", "b").where("n > 0").count() == 0


def test_fold_components_equal_a_refit(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + [0, 50, 1e4]
    rows = [(D(2020, 1, 1) + dt.timedelta(days=i), *map(float, r), 5.0) for i, r in enumerate(base)]
    daily = spark.createDataFrame(rows, "date date, wx_a double, wx_b double, wx_c double, wx_same double")
    ranges = splits.walk_forward_ranges(splits.date_range(daily), 60, 20, 35, 0)
    fits = dims.fold_pca(daily, 2, ranges)
    assert len(fits) == ranges.count() > 2
    for f in ranges.collect():
        want = dims.fit_pca(daily, 2, daily.where(F.col("date").between(f["tr_start"], f["tr_end"])).select("date"))
        got = fits[f["fold"]]
        assert got.cols == want.cols and got.names == want.names
        assert got.mean == pytest.approx(want.mean, rel=1e-9) and got.std == pytest.approx(want.std, rel=1e-7)
        assert np.array(got.loadings) == pytest.approx(np.array(want.loadings), abs=1e-6)
    assert dims.fold_pca(daily.select("date"), 2, ranges) == {} and dims.fold_pca(daily.limit(0), 2, ranges) == {}


def test_folds_fitted_together_equal_fold_by_fold(spark):
    panel = planted(spark, 260, 3)

    def each(tr, features, horizons, lookback, sc):
        return training.fit_point(tr, features, horizons, lookback, sc, loss="squaredError")

    args = (["x"], [1, 2], 3, 90, 30, 45)
    key = ["fold", "symbol", "label_date", "horizon"]
    want = {tuple(r[c] for c in key): r for r in training.walk_forward_predictions(panel, *args, fit=each).collect()}
    got = {tuple(r[c] for c in key): r for r in training.walk_forward_linear(panel, *args).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for k, r in want.items():
        assert got[k]["predicted"] == pytest.approx(r["predicted"], abs=1e-7) and got[k]["actual"] == r["actual"]
    with pytest.raises(NoTrainingRows):
        training.walk_forward_linear(panel.where("false"), *args)


def test_folds_cost_no_further_pass(spark, tmp_path):
    """The panel is scanned once for all folds; what is joined to the folds is one row per date."""
    panel = planted(spark, 200, 2)
    marked = label_rows(panel, 4, ["x"], [1], "2020-01-01", "2020-12-31")
    marked.write.parquet(str(tmp_path / "marked"))
    stored = spark.read.parquet(str(tmp_path / "marked"))
    daily = moments.daily_products(stored, [F.col("x"), F.col("close")])
    assert daily._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    totals = moments.running(daily)
    ranges = splits.walk_forward_ranges(splits.date_range(panel), 60, 20, 5, 0)
    plan = moments.range_totals(totals, ranges, "tr_start", "tr_end")._jdf.queryExecution().executedPlan().toString()
    assert "marked" not in plan and "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Inner", "")
    assert scaler_values(fit_window_scaler(marked, ["x"], 4))["x"][1] > 0


def test_horizons_in_trading_days_have_their_own_labels(spark):
    summary = ["last_x"]
    fc = training.Forecaster(["x"], [5, 21, 7], 3, FLAT, chosen=summary, linear=[[0.0, 1.0]] * 3, residual_quantiles={(h, 0.9): 0.5 for h in (5, 21, 7)})
    panel = planted(spark, 20, 1)
    assert [c for c in scoring.score_point(panel, fc, trading=True).columns if c.endswith("logret")] == ["pred_1w_logret", "pred_1m_logret", "pred_7d_logret"]
    assert [c for c in scoring.score_point(panel, fc).columns if c.endswith("logret")] == ["pred_5d_logret", "pred_21d_logret", "pred_1w_logret"]
    row = scoring.score_quantile(panel, fc, [0.9], trading=True).first()
    assert row["pred_1m_p90_logret"] == pytest.approx(scoring.score_point(panel, fc).first()["pred_21d_logret"] + 0.5)


def test_fits_store_only_what_they_read(spark, sf, monkeypatch):
    from tickloom.catalog import models

    kept, real = {}, models.staged
    monkeypatch.setattr(models, "staged", lambda df, name="staged": kept.setdefault(name, df.columns) and real(df, name))
    models._fit_closed_form(spark, sf)
    assert kept["panel"] == ["symbol", "date", "close", "logret_1d"]


def test_tracked_query_computes_its_windows_once(spark, sf, monkeypatch):
    from tickloom.catalog import models

    class Seen(Exception):
        pass

    def fit(train, val, *args, **options):
        raise Seen([f for side in (train, val) for f in side.inputFiles()])

    monkeypatch.setattr(tracked, "fit_tracked", fit)
    with pytest.raises(Seen) as told:
        models.k4_tracked(spark, sf)
    assert told.value.args[0] and all("/labels-" in f for f in told.value.args[0])
