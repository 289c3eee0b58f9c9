import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import views
from tickloom.operators import calendar, features, joins, scaler, targets, windows
from tickloom.operators.aggregates import daily_ohlcv
from tickloom.plans.features import build_features, daily_panel, top_movers

D = dt.date


def panel_of(spark, closes, symbol="a", start=D(2020, 1, 1)):
    rows = [(symbol, start + dt.timedelta(days=i), *[float(c)] * 4) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double")


def values(df, col):
    return [r[col] for r in df.orderBy("symbol", "date").collect()]


def test_densify_and_fill(spark):
    rows = [("a", D(2020, 1, 2), 2.0), ("a", D(2020, 1, 3), None), ("a", D(2020, 1, 6), 4.0), ("b", D(2020, 1, 4), 9.0)]
    p = spark.createDataFrame(rows, "symbol string, date date, close double")
    dense = calendar.densify_calendar(p, (D(2020, 1, 1), D(2020, 1, 7)))
    assert values(dense, "close") == [None, 2.0, None, None, None, 4.0, None] + [None] * 3 + [9.0] + [None] * 3
    again = calendar.densify_calendar(dense, (D(2020, 1, 1), D(2020, 1, 7)))
    assert values(again, "close") == values(dense, "close")
    filled = calendar.fill_prices(dense)
    assert values(filled, "close") == [2.0] * 5 + [4.0] * 2 + [9.0] * 7
    assert sum(values(filled, "is_trading_day")) == 3
    assert values(calendar.bfill(dense, ["close"]), "close")[:3] == [2.0, 2.0, 4.0]
    assert values(calendar.ffill(dense, ["close"]), "close")[:3] == [None, 2.0, 2.0]


def test_returns_and_spans(spark):
    closes = [math.exp(0.1 * i * i) for i in range(40)]
    out = features.add_technicals(panel_of(spark, closes))
    r1, v7, m7, r7 = (values(out, c) for c in ("logret_1d", "vol_7d", "mom_7d", "logret_7d"))
    expected = [0.1 * (2 * i - 1) for i in range(40)]
    assert r1[0] is None and r1[1:] == pytest.approx(expected[1:])
    assert r7[:5] == [None] * 5 and r7[5] == pytest.approx(0.1 * 25)
    assert v7[1] == 0.0 and v7[10] == pytest.approx(np.std(expected[4:11], ddof=1))
    assert m7[:7] == [0.0] * 7 and m7[7] is None and m7[8] == pytest.approx(expected[8] - expected[1])
    assert set(values(out, "vol_1d")) == {0.0}
    long = features.add_technicals_long(panel_of(spark, closes * 2))
    assert values(long, "mom_63d")[:63] == [0.0] * 63 and values(long, "logret_1d")[0] == 0.0


def test_targets(spark):
    p = panel_of(spark, [1.0, 2.0, 4.0, 8.0])
    out = targets.calendar_targets(p, [2])
    assert values(out, "target_2d")[:2] == pytest.approx([math.log(4)] * 2) and values(out, "mask_2d") == [1, 1, 0, 0]
    assert values(targets.price_change_targets(p, [1]), "target_1d") == [1.0, 2.0, 4.0, None]
    t = p.withColumn("is_trading_day", F.dayofmonth("date") != 2)
    out = targets.trading_targets(t, [1])
    assert values(out, "target_td1") == [pytest.approx(math.log(4)), None, pytest.approx(math.log(2)), None]
    assert values(out, "mask_td1") == [1, 0, 1, 0]


def test_inference_window_pads_and_skips(spark):
    long, two, one = panel_of(spark, range(1, 9)), panel_of(spark, [5.0, 6.0], "b"), panel_of(spark, [7.0], "c")
    bad = panel_of(spark, [1.0, -1.0], "d")
    w = windows.inference_window(long.unionByName(two).unionByName(one).unionByName(bad), "2020-01-08", 4, ["close"])
    got = {r["symbol"]: r for r in w.collect()}
    assert set(got) == {"a", "b"}
    assert [x[0] for x in got["a"]["x"]] == [4.0, 5.0, 6.0, 7.0] and all(got["a"]["m"])
    assert [x[0] for x in got["b"]["x"]] == [5.0] * 4 and got["b"]["m"] == [False, False, False, True]
    strict = windows.inference_window(long.unionByName(two), "2020-01-08", 4, ["close"], allow_fallback=False)
    assert [r["symbol"] for r in strict.collect()] == ["a"]


def test_last_window_skips_short(spark):
    p = panel_of(spark, range(1, 6)).unionByName(panel_of(spark, [1.0], "b"))
    rows = windows.last_window(p, 3, ["close"]).collect()
    assert len(rows) == 1 and [x[0] for x in rows[0]["x"]] == [3.0, 4.0, 5.0]


def test_as_of_gap(spark):
    p = panel_of(spark, [1.0, 2.0]).unionByName(panel_of(spark, [3.0], "b", D(2020, 2, 1)))
    assert [(r["symbol"], r["close"]) for r in joins.as_of_row(p, "2020-01-20").collect()] == [("a", 2.0)]
    assert joins.as_of_row(p, "2020-01-20", 5).count() == 0


def test_label_windows_match_brute_force(spark):
    rng = np.random.default_rng(0)
    closes = {s: np.exp(rng.normal(size=n).cumsum() / 10) for s, n in (("a", 30), ("b", 17), ("c", 6))}
    p = None
    for s, c in closes.items():
        q = panel_of(spark, [float(v) for v in c], s)
        p = q if p is None else p.unionByName(q)
    L, H, start, end = 5, [2, 4], D(2020, 1, 3), D(2020, 1, 22)
    got = {(r["symbol"], r["label_date"]): r for r in windows.label_range_windows(p, L, ["close"], H, str(start), str(end)).collect()}
    expected = {}
    for s, c in closes.items():
        days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(c))]
        keep = [i for i, d in enumerate(days) if start - dt.timedelta(days=L + 5) <= d <= end + dt.timedelta(days=max(H))]
        c, days = c[keep].astype("float32"), [days[i] for i in keep]
        for t in range(L, len(c) - max(H)):
            if start <= days[t] <= end:
                expected[(s, days[t])] = (c[t - L : t], [math.log(c[t + h]) - math.log(c[t]) for h in H])
    assert set(got) == set(expected) and expected
    for k, (x, y) in expected.items():
        assert [v[0] for v in got[k]["x"]] == pytest.approx(x.tolist())
        assert got[k]["y"] == pytest.approx(y, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("sample", [True, False])
def test_scaler_equals_exploded_windows(spark, sf, sample):
    panel = build_features(views.ticks(spark, sf), views.TICK_ORDER, [])
    marked = windows.label_rows(panel, 20, ["close", "vol_7d"], [7], "1996-01-01", "1997-06-30").cache()
    fitted = {r["feature"]: r for r in scaler.fit_window_scaler(marked, ["close", "vol_7d"], 20, sample).collect()}
    w = windows.label_range_windows(panel, 20, ["close", "vol_7d"], [7], "1996-01-01", "1997-06-30")
    rows = w.select(F.explode("x").alias("r")).select(F.get("r", 0).cast("double").alias("close"), F.get("r", 1).cast("double").alias("vol_7d"))
    dev = F.stddev_samp if sample else F.stddev_pop
    for c in ("close", "vol_7d"):
        e = rows.agg(F.count(c).alias("n"), F.avg(c).alias("m"), dev(c).alias("s")).first()
        assert fitted[c]["n"] == e["n"] and fitted[c]["mean"] == pytest.approx(e["m"]) and fitted[c]["std"] == pytest.approx(e["s"])


def test_scaler_of_constant_feature(spark):
    p = panel_of(spark, [50_000.25] * 40).unionByName(panel_of(spark, [50_000.25] * 40, "b"))
    marked = windows.label_rows(p, 5, ["close"], [2], "2020-01-01", "2020-02-20")
    assert scaler.fit_window_scaler(marked, ["close"], 5, sample=False).first()["std"] == 1.0
    assert scaler.fit_window_scaler(marked, ["close"], 5).first()["std"] == pytest.approx(1e-4)
    with pytest.raises(scaler.NoTrainingRows):
        scaler.fit_window_scaler(marked.where("false"), ["close"], 5)


def test_movers_equal_full_history(spark, sf):
    t = views.ticks(spark, sf)
    fast = [tuple(r) for r in top_movers(t, views.TICK_ORDER, 5).collect()]
    full = features.add_technicals(daily_panel(t, views.TICK_ORDER))
    last = full.agg(F.max("date")).first()[0]
    slow = full.where(F.col("date") == F.lit(last)).orderBy(F.desc("logret_30d"), F.desc("symbol")).limit(5)
    slow = [tuple(r) for r in slow.select("symbol", "date", "close", "logret_30d", "vol_30d", "hl_spread").collect()]
    assert [f[:2] for f in fast] == [s[:2] for s in slow]
    assert [v for f in fast for v in f[2:]] == pytest.approx([v for s in slow for v in s[2:]])


def test_movers_carry_the_last_present_price(spark):
    """Two symbols with the same prices, one with a missing or NaN price on its newest old day."""
    days = [(s, D(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i) for s in "AB" for i in range(60)]
    for hole in (None, float("nan")):
        rows = [(s, d, p, p, p, hole if (s, d) == ("B", D(2020, 1, 29)) else p) for s, d, p in days]
        t = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double")
        t = t.where("date <= '2020-01-29' or date >= '2020-02-20'")
        full = features.add_technicals(daily_panel(t, ["date"])).where("date = '2020-02-29'")
        want = {r["symbol"]: (r["close"], r["logret_30d"], r["vol_30d"]) for r in full.collect()}
        got = {r["symbol"]: (r["close"], r["logret_30d"], r["vol_30d"]) for r in top_movers(t, ["date"]).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_features_do_not_depend_on_partitioning(spark, sf):
    def digest(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        f = build_features(views.ticks(spark, sf), views.TICK_ORDER, [7])
        return f.agg(F.count("*"), F.sum("asset_id"), F.round(F.sum("vol_30d"), 6), F.round(F.sum("target_7d"), 6)).first()

    try:
        assert digest(3) == digest(11)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_symbol_is_reduced_before_it_is_windowed(spark):
    # one symbol and one of its days hold most ticks
    t = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("symbol"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 90).cast("int")).alias("date"),
        *[(F.col("id") % 97 + 1).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("id").alias("seq"),
    )
    daily = daily_ohlcv(t, ["seq"])
    assert daily.groupBy("symbol").count().agg(F.max("count")).first()[0] <= 90
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("Exchange hashpartitioning") == 1
    assert build_features(t, ["seq"], [7]).count() == 90 * t.select("symbol").distinct().count()


def test_lookback_windows_modes(spark):
    nan = None
    p = panel_of(spark, [1.0] * 8).withColumns(
        {"f": F.when(F.dayofmonth("date") != 2, F.dayofmonth("date").cast("double")), "asset_id": F.dayofmonth("date")}
    )
    p = p.withColumn("is_trading_day", F.dayofmonth("date") >= 4)
    p = targets.calendar_targets(p, [1, 3])
    args = (p, 2, ["f"], ["target_1d", "target_3d"], ["mask_1d", "mask_3d"])
    got = {r["label_date"].day: r for r in windows.lookback_windows(*args).collect()}
    assert sorted(got) == [3, 4, 5]  # targets end at day 5
    assert got[3]["x"] == [[1.0], [nan]] and got[3]["m"] == [True, False] and got[3]["asset_id"] == 2
    loose = windows.lookback_windows(*args, require_all=False)
    assert sorted(r["label_date"].day for r in loose.collect()) == [3, 4, 5, 6, 7]
    trading = {r["label_date"].day: r["m"] for r in windows.lookback_windows(*args, mode="trading").collect()}
    assert trading == {5: [False, True]}
    assert windows.count_samples(*args, mode="trading").first()["n_samples"] == 1


def test_rolling_deviations_without_sliding_frames(spark):
    rows = [("a", D(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate([None, 1e9, -1e9, *[0.1] * 40, None, *[math.sin(i) for i in range(60)]])]
    rows += [("b", D(2020, 1, 1), 3.0), ("b", D(2020, 1, 2), 5.0)]
    panel = spark.createDataFrame(rows, "symbol string, date date, v double")
    spans = {f"s{k}": k for k in (1, 2, 3, 7, 20, 30, 63)}
    out = features.rolling_stds(panel, "v", spans)
    # a sliding frame adds up every row of the span again
    assert "specifiedwindowframe(RowFrame, -" not in out.drop("s1")._jdf.queryExecution().optimizedPlan().toString().replace("currentrow$()), ", "").lower()
    got = out.orderBy("symbol", "date").collect()
    for name, k in spans.items():
        for i, r in enumerate(got):
            near = [x[2] for x in rows[max(0, i - k + 1) : i + 1] if x[0] == r["symbol"] and x[2] is not None]
            assert r[name] == pytest.approx(np.std(near, ddof=1) if k > 1 and len(near) > 1 else 0.0, rel=1e-9, abs=1e-12)
    assert out.columns == ["symbol", "date", "v", *spans]


def test_dense_panel_is_dealt_out_by_its_size(spark, monkeypatch):
    from tickloom.plans import features as plan_features

    rows = [(f"s{i}", D(2020, 1, 1) + dt.timedelta(days=99 * (i % 2)), 1.0) for i in range(40)]
    ticks = spark.createDataFrame(rows, "symbol string, date date, close double")
    monkeypatch.setattr(plan_features, "TASK_ROWS", 200)
    panel = daily_panel(ticks, ["close"])
    assert panel.rdd.getNumPartitions() >= 15 and panel.count() == 4000
