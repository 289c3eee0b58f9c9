import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import views
from tickloom.functions.ordering import dense_index, key_at
from tickloom.functions.quantiles import exact_quantiles
from tickloom.operators import dims, rank, splits
from tickloom.operators.joins import assign_asset_id
from tickloom.plans import scoring, training
from tickloom.sources import sinks

D = dt.date
FLAT = {"x": (0.0, 1.0)}


def test_dense_index_over_many_partitions(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") * 7919) % 311).alias("symbol"))
    ids, size = dense_index(df.unionByName(spark.createDataFrame([(None,)], "symbol string")), "symbol", "asset_id")
    expected = {s: i for i, s in enumerate(sorted({f"k{(i * 7919) % 311}" for i in range(1000)}))}
    assert size == 311 and {r["symbol"]: r["asset_id"] for r in ids.collect()} == expected
    # a dimension beyond the broadcast threshold is joined by shuffle, with the same ids
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["symbol"]: r["asset_id"] for r in assign_asset_id(df).distinct().collect()} == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unknown = assign_asset_id(spark.createDataFrame([("zzz",)], "symbol string"), (ids, size))
    assert unknown.first()["asset_id"] == 0


@pytest.mark.parametrize("position", [0, 1, 499, 777, 999])
def test_key_at_equals_sorted_position(spark, position):
    rows = sorted((f"s{i % 13}", D(2020, 1, 1) + dt.timedelta(days=i // 13)) for i in range(1000))
    df = spark.createDataFrame(rows, "symbol string, label_date date").repartition(5)
    found = key_at(df, "symbol", "label_date", lambda n: position)
    assert (found.major, found.minor, found.total) == (*rows[position], 1000)


@pytest.mark.parametrize("ratio", [0.0, 0.2, 0.5, 1.0])
def test_holdout_sizes(spark, ratio):
    df = spark.range(101).select(F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("label_date"))
    assert splits.holdout_split(df, ratio).where("role = 'val'").count() == int(101 * ratio)


def test_quantiles_of_hot_group_equal_numpy(spark):
    rng = np.random.default_rng(1)
    hot, cold = rng.normal(size=5000).round(2), rng.normal(size=7)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("cold", float("nan")), ("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    # one way for all groups, the other one, and both
    for most in (10**6, 0, 100):
        out = exact_quantiles(df, ["k"], ["v"], [0.0, 0.1, 0.5, 0.9, 1.0], most)
        got = {(r["k"], r["prob"]): r["value"] for r in out.collect()}
        assert len(got) == out.count() == 10
        for k, data in (("hot", hot), ("cold", cold)):
            for p in (0.0, 0.1, 0.5, 0.9, 1.0):
                assert got[(k, p)] == pytest.approx(np.quantile(data, p))
    assert exact_quantiles(df.where("k IS NULL"), ["k"], ["v"], [0.5]).count() == 0
    # values are dealt out by group and partition, never by group alone
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan and "BroadcastNestedLoop" not in plan


def test_quantiles_of_few_groups_store_and_shuffle_no_values(spark, monkeypatch):
    from tickloom.functions import quantiles

    rng = np.random.default_rng(3)
    data = {1: np.r_[rng.standard_cauchy(5000), [1.7e308, -1.7e308]], 2: rng.normal(size=3000).round(1), 3: np.array([4.5]), 4: np.array([0.0, 5e-324, 5e-324, 1.0])}
    rows = [(k, float(v)) for k, part in data.items() for v in part] + [(2, float("nan")), (2, None), (None, 1.0), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    monkeypatch.setattr(quantiles, "staged", None)  # nothing may be stored
    probs = [0.0, 0.123, 0.5, 0.9, 1.0]
    got = {(r["k"], r["measure"], r["prob"]): r["value"] for r in exact_quantiles(df, ["k"], ["v"], probs, few=True).collect()}
    assert got.keys() == {(k, "v", p) for k in data for p in probs}
    for k, part in data.items():
        assert [got[k, "v", p] for p in probs] == pytest.approx([np.quantile(part, p) for p in probs], rel=1e-12)
    assert exact_quantiles(df.where("k = 5"), ["k"], ["v"], probs, few=True).count() == 0


def test_walk_forward_folds(spark):
    days = spark.createDataFrame([(D(2020, 1, 1), D(2021, 12, 31))], "lo date, hi date")
    closed = splits.walk_forward_ranges(days, 100, 50, 60, hmax=30).orderBy("fold").collect()
    assert closed[0]["tr_end"] == closed[0]["va_start"] == D(2020, 4, 10)
    assert all(r["va_end"] <= D(2021, 12, 1) for r in closed) and closed[-1]["va_end"] + dt.timedelta(days=60) > D(2021, 12, 1)
    assert splits.walk_forward_ranges(days, 100, 50, 60, 30, embargo_days=7).first()["va_start"] == D(2020, 4, 17)
    assert splits.walk_forward_ranges(days, 9000, 50, 60).count() == 0
    s = spark.range(400).select(F.lit("a").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("label_date"))
    s = s.where("label_date < '2020-06-01' or label_date > '2020-09-01'")
    got = splits.walk_forward_assign(s, 100, 50, 60)
    sides = got.groupBy("fold", "label_date").agg(F.count("*").alias("n"))
    assert sides.agg(F.max("n")).first()[0] == 1
    folds = sorted(r["fold"] for r in got.select("fold").distinct().collect())
    assert folds == list(range(len(folds)))


def test_rank_ties_and_nearest(spark):
    df = spark.createDataFrame([("a", 1.0), ("c", 1.0), ("b", 2.0), ("d", None)], "symbol string, s double")
    assert [r["symbol"] for r in rank.top_k(df, "s", 2).collect()] == ["b", "c"]
    h = spark.createDataFrame([(0, -7), (1, 5), (2, 9), (3, 400)], "i int, d int")
    got = {r["label"]: r["idx"] for r in rank.nearest_match(h, "d", "i", {"w": 7, "y": 365}, pinned={"y": 2}).collect()}
    assert got == {"w": 1, "y": 2}
    assert rank.horizon_context([5, 9, 400]) == {"1w": 0, "1m": 1, "6m": 1, "1y": 2}


def test_prediction_table_fallbacks(spark):
    s = spark.createDataFrame([("a", 0, 0.1, 10.0), ("b", 0, 0.2, -1.0)], "symbol string, horizon_idx int, logret double, current_price double")
    r = {x["symbol"]: x for x in rank.prediction_table(s, [7], "2020-01-01").collect()}
    assert len(r["a"]) == 17 and r["a"]["pred_1y_logret"] == r["a"]["pred_1w_logret"] == 0.1
    assert r["a"]["expected_price"] == pytest.approx(10 * np.exp(0.1)) and r["b"]["expected_price"] is None
    assert r["a"]["expected_price_date"] == D(2020, 1, 8)


def test_horizons_given_as_dates(spark):
    dates = ["2020-01-06", D(2020, 2, 3), "2019-12-01", "2021-01-05 09:30:00"]
    assert rank.day_offsets(dates, "2020-01-01") == [5, 33, -31, 370]
    assert rank.day_offsets([7, "2020-01-01"], "2020-01-01 16:00:00") == [7, 0]
    s = spark.createDataFrame([("a", i, i / 10, 10.0) for i in range(4)], "symbol string, horizon_idx int, logret double, current_price double")
    by_date, by_days = (rank.prediction_table(s, h, "2020-01-01").collect() for h in (dates, [5, 33, -31, 370]))
    assert by_date == by_days and by_date[0]["expected_price_date"] == D(2021, 1, 5)


def test_weather_pca(spark, sf):
    daily = dims.weather_daily(views.weather(spark, sf))
    fit = dims.fit_pca(daily, 3)
    w = np.array(fit.loadings)
    assert w @ w.T == pytest.approx(np.eye(3), abs=1e-9)
    assert all(row[np.abs(row).argmax()] > 0 for row in w)
    out = dims.transform_pca(daily, fit)
    v = out.agg(*[F.var_pop(n) for n in fit.names]).first()
    assert list(v) == sorted(v, reverse=True)
    some = daily.where(F.year("date") == 1996).select("date")
    assert dims.fit_pca(daily, 3, some).mean != fit.mean
    assert dims.fit_pca(daily, 3, some.where("false")) is None
    assert dims.transform_pca(daily, None, ["wx_pca_0"]).agg(F.max("wx_pca_0")).first()[0] == 0.0


def test_news_without_usable_embeddings(spark):
    rows = [(D(2020, 1, 1), [1.0, None], [0.5]), (D(2020, 1, 1), None, None), (D(2020, 1, 2), [], [])]
    n = spark.createDataFrame(rows, "date date, sentiment array<double>, embeddings array<double>")
    day = {r["date"]: r for r in dims.news_daily(n).collect()}
    assert (day[D(2020, 1, 1)]["news_sent_mean"], day[D(2020, 1, 1)]["news_count"]) == (0.5, 2)
    assert dims.news_embedding_pca(n.drop("embeddings")).columns == ["date", "sentiment"]


def test_fx_with_gaps_bases_and_repeats(spark):
    rows = [
        (D(2020, 1, 1), "EUR", None, 1.0), (D(2020, 1, 2), "EUR", 2.0, None), (D(2020, 1, 3), "EUR", 4.0, 3.0),
        (D(2020, 1, 3), "EUR", 4.0, 3.0),
    ]
    fx = spark.createDataFrame(rows, "date date, base_currency string, A double, B double")
    got = [r[1] for r in dims.fx_log_return(fx).orderBy("date").collect()]
    assert got == pytest.approx([0.0, 0.0, (np.log(2) + np.log(3)) / 2], rel=1e-6)
    assert dims.fx_log_return(fx.select("date", "base_currency")).where("eur_fx_logret = 0").count() == 3


def planted(spark, n=400, symbols=4):
    """Tomorrow's log return is 0.5 x today's feature."""
    rng = np.random.default_rng(2)
    rows = []
    for s in range(symbols):
        x = rng.normal(size=n) / 50
        logp = np.concatenate([[0.0, 0.0], 0.5 * x[:-2]]).cumsum() + 3
        for i in range(n):
            p = float(np.exp(logp[i]))
            rows.append((f"s{s}", D(2020, 1, 1) + dt.timedelta(days=i), p, p, float(x[i])))
    return spark.createDataFrame(rows, "symbol string, date date, open double, close double, x double")


@pytest.mark.parametrize("loss", ["huber", "squaredError"])
def test_fit_recovers_planted_signal(spark, loss):
    # row t moves by 0.5 * x[t-2]; the label row is t, its window ends at t-1
    panel = planted(spark)
    rows, sc = training.training_rows(panel, 3, ["x"], [1], "2020-01-01", "2021-06-30", FLAT)
    fc = training.fit_point(rows, ["x"], [1], 3, sc, loss=loss, inputs=["last_x"])
    assert fc.models[0].coefficients[0] == pytest.approx(0.5, abs=0.02)
    fc = training.fit_quantile(fc, rows, [0.1, 0.9])
    assert fc.residual_quantiles[(1, 0.1)] <= fc.residual_quantiles[(1, 0.9)]
    assert training.validation_loss(fc, rows)[0] < 1e-4
    q = scoring.score_quantile(panel, fc, [0.1, 0.9])
    assert q.columns[1:3] == ["pred_1d_p10_logret", "pred_1d_p10_ret"] and q.count() == 4


def test_window_and_row_summaries_agree(spark):
    from tickloom.operators.windows import label_range_windows

    panel = planted(spark, 60, 2)
    rows, _ = training.training_rows(panel, 5, ["x"], [1], "2020-01-01", "2020-03-01", {"x": (0.1, 2.0)})
    w = training.summarise_windows(label_range_windows(panel, 5, ["x"], [1], "2020-01-01", "2020-03-01"), ["x"], {"x": (0.1, 2.0)})
    a = {(r["symbol"], r["label_date"]): (r["last_x"], r["mean_x"]) for r in rows.collect()}
    b = {(r["symbol"], r["label_date"]): (r["last_x"], r["mean_x"]) for r in w.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_walk_forward_with_weather_refit(spark):
    panel = planted(spark, 300, 2)
    wx = panel.select("date").distinct().withColumns({"wx_tavg": F.dayofyear("date").cast("double"), "wx_prcp": F.dayofmonth("date").cast("double")})
    metrics, last = training.walk_forward_evaluate(panel, ["x"], [1], 3, 100, 40, 80, weather_daily=wx)
    rows = metrics.orderBy("fold").collect()
    assert len(rows) == 2 and all(r["n_val"] == 2 * 41 and r["val_loss"] < 0.01 for r in rows)
    assert last.features == ["x", "wx_pca_0", "wx_pca_1"]


def test_meta_round_trip(spark, tmp_path):
    ids = spark.createDataFrame([("a", 0)], "symbol string, asset_id int")
    sc = spark.createDataFrame([("x", 1.0, 2.0, 3)], "feature string, mean double, std double, n long")
    meta = sinks.FeatureMeta(["x", "open"], [7, 30], 90, "open", ["target_7d"], ["mask_7d"])
    sinks.save_feature_meta(meta, sc, ids, str(tmp_path))
    again, sc2, ids2 = sinks.load_feature_meta(spark, str(tmp_path))
    assert again == meta and sc2.first()["std"] == 2.0 and ids2.first()["asset_id"] == 0
