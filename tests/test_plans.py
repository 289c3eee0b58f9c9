import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from tickloom import views
from tickloom.operators import joins, rank
from tickloom.operators.calendar import date_bounds
from tickloom.plans.features import build_features, daily_panel, prep_data, recent_days


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_use_one_symbol_exchange(spark, sf):
    p = plan(daily_panel(views.ticks(spark, sf), views.TICK_ORDER, (dt.date(1995, 1, 1), dt.date(1996, 1, 1))))
    assert p.count("Exchange hashpartitioning(symbol") == 2  # daily reduction, then everything else
    full = plan(build_features(views.ticks(spark, sf), views.TICK_ORDER).drop("asset_id"))
    assert full.count("hashpartitioning(symbol#") <= 4 and "CartesianProduct" not in full and "NestedLoop" not in full


def test_date_joins_broadcast_small_and_shuffle_large(spark, sf):
    from tickloom.session import size_checked

    p = views.prices(spark, sf)
    dim = p.groupBy("date").agg(F.avg("close").alias("eur_fx_logret"))
    assert "BroadcastHashJoin" in plan(joins.join_fx(p, dim))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan(p.join(size_checked(dim), "date", "left"))
        assert "SortMergeJoin" in large and "BroadcastHashJoin" not in large
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k_and_pushdown(spark, sf):
    assert "TakeOrderedAndProject" in plan(rank.top_k(views.prices(spark, sf), "close", 5))
    narrow = plan(views.ticks(spark, sf).select("symbol").distinct())
    assert "ReadSchema: struct<l_suppkey:bigint>" in narrow


def test_prep_data_end_to_end(spark, sf, tmp_path):
    t = views.ticks(spark, sf)
    paths = {n: str(tmp_path / n) for n in ("stock", "crypto", "fx", "out")}
    t.where("source = 'stock'").write.parquet(paths["stock"])
    t.where("source = 'crypto'").write.parquet(paths["crypto"])
    views.fx_wide(spark, sf).write.parquet(paths["fx"])
    out = prep_data(spark, paths["stock"], paths["crypto"], paths["fx"], paths["out"], views.TICK_ORDER, [7])
    lo, hi = date_bounds(t)
    assert out.count() == ((hi - lo).days + 1) * t.select("symbol").distinct().count()
    assert out.where("eur_fx_logret <> 0").count() > 0 and {"target_7d", "mask_7d", "asset_id"} <= set(out.columns)


def test_movers_push_their_range_down(spark, sf, tmp_path):
    views.ticks(spark, sf).write.parquet(str(tmp_path / "ticks"))
    days = recent_days(spark.read.parquet(str(tmp_path / "ticks")), views.TICK_ORDER, dt.date(2001, 10, 1), 31)
    scans = [x for x in plan(days).split("\n") if "FileScan" in x]
    assert len(scans) == 2 and any("GreaterThan(date,2001-08-31)" in x for x in scans) and any("LessThanOrEqual(date,2001-08-31)" in x for x in scans)
    assert all("volume" not in x for x in scans if "LessThanOrEqual" in x)


def test_features_read_ticks_once(spark, sf):
    held = set(spark._jsc.getPersistentRDDs())
    before = plan(build_features(views.ticks(spark, sf), views.TICK_ORDER, [7]))
    assert "lineitem" not in before and set(spark._jsc.getPersistentRDDs()) <= held


def test_registry_is_consistent(spark):
    queries, oracles = entrypoint.queries(), entrypoint.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert entrypoint.entry(spark).columns == ["symbol", "date", "close", "logret_30d", "vol_30d", "hl_spread"]


def test_stored_panels_hold_only_prices_that_are_read(spark, sf):
    from tickloom.catalog import models

    path, _ = models._stored_panel(spark, sf)
    assert set(spark.read.parquet(path).columns) == {"symbol", "date", "open", "close", "is_trading_day"}
    assert not {"volume", "num_trades", "source", "open"} & set(models._panel(spark, sf).columns)
