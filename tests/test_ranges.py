import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import planted
from tickloom.operators import windows
from tickloom.plans import scoring

D = dt.date
KEY = ["symbol", "label_date", "x", "m", "asset_id", "y"]


def panel_of(spark):
    panel = planted(spark, 150, 3).withColumns({"asset_id": F.substring("symbol", 2, 1).cast("int"), "is_trading_day": F.dayofmonth("date") % 3 > 0})
    panel = panel.withColumn("x", F.when(F.col("symbol") != "s1", F.col("x"))).withColumns({"t": F.when(F.dayofmonth("date") != 9, F.col("close")), "k": F.lit(1)})
    # a symbol with a short history, one row alone, and a panel with gaps
    return panel.where("symbol != 's2' OR date < '2020-01-09' OR date = '2020-03-01'")


def rows(df):
    return {(r["symbol"], r["label_date"]): tuple(repr(r[c]) for c in KEY) for r in df.select(*KEY).collect()}


@pytest.mark.parametrize("lookback, span", [(1, 1), (5, 5), (5, 16), (12, 7), (5, 1000)])
def test_windows_in_ranges_equal_whole_histories(spark, lookback, span):
    panel = panel_of(spark)
    for mode in ("finite", "trading"):
        args = (panel, lookback, ["x", "close"], ["t"], ["k"], mode)
        assert rows(windows.lookback_windows(*args, span_rows=span)) == rows(windows.lookback_windows(*args)) != {}
    args = (panel, lookback, ["x", "close"], [1, 3], "2020-01-05", "2020-05-01")
    assert rows(windows.label_range_windows(*args, span_rows=span)) == rows(windows.label_range_windows(*args)) != {}
    assert windows.lookback_windows(panel.where("false"), lookback, ["x"], ["t"], ["k"], span_rows=span).count() == 0


def test_one_hot_symbol_is_many_tasks(spark):
    day = F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int"))
    one = spark.range(20_000).select(F.lit("hot").alias("symbol"), day.alias("date"), F.col("id").cast("double").alias("x"), F.lit(0).alias("asset_id"), F.lit(1.0).alias("t"), F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = windows.lookback_windows(one, 10, ["x"], ["t"], ["k"], span_rows=500)
        sizes = [r["n"] for r in cut.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 19_990 and len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_batch_models_load_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda x: np.stack([np.nan_to_num(x[:, -1, 0], nan=-1.0), x[:, :, 1].sum(axis=1)], axis=1)

    schema = "id int, x array<array<float>>"
    df = spark.createDataFrame([(i, [[float(i), 1.0], [float(i) if i % 5 else None, 2.0]]) for i in range(500)], schema).repartition(6)
    got = {r["id"]: (r["pred_0"], r["pred_1"]) for r in scoring.batch_scorer(make, 2, 2, 2, batch_rows=16)(df).collect()}
    assert got == {i: (float(i) if i % 5 else -1.0, 3.0) for i in range(500)}
    loads = [n.split("-")[0] for n in __import__("os").listdir(folder)]
    assert len(loads) == len(set(loads)), "one load a worker process, whatever its batches and tasks"
    assert scoring.batch_scorer(make, 2, 2, 2)(df.where("false")).count() == 0


def test_ranges_are_windowed_and_not_gathered(spark):
    panel = panel_of(spark)
    for cut in (
        windows.lookback_windows(panel, 5, ["x", "close"], ["t"], ["k"], span_rows=16),
        windows.label_range_windows(panel, 5, ["x", "close"], [1, 3], "2020-01-05", "2020-05-01", span_rows=16),
    ):
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" not in plan and "Generate inline" not in plan and "collect_list" in plan


def test_sums_of_windows_of_any_length(spark):
    from tickloom.catalog.base import LOOKBACK
    from tickloom.catalog.series import _sums

    made = [[[float(i), None if i % 3 else 2.0] for i in range(n)] for n in (0, 1, LOOKBACK, LOOKBACK + 5)]
    df = spark.createDataFrame([(n, x, [i % 2 == 0 for i in range(len(x))], [1.0]) for n, x in enumerate(made)] + [(9, None, None, [2.0])], "id int, x array<array<float>>, m array<boolean>, y array<float>")
    out = _sums(df, 2, 1)
    # steps are added up by compiled terms, one by one only in arrays longer than the lookback
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    for n, x in enumerate(made):
        r = got[n]
        assert (r["n_steps"], r["n_ok"]) == (len(x), (len(x) + 1) // 2)
        assert (r["sum_0"], r["sum_1"]) == (sum(v[0] for v in x), sum(v[1] or 0.0 for v in x))
        assert r["last_0"] == (x[-1][0] if x else None) and r["y_0"] == 1.0
    assert got[9]["sum_0"] is None and got[9]["n_steps"] == got[9]["n_ok"] == spark.range(1).select(F.size(F.lit(None).cast("array<int>"))).first()[0]
