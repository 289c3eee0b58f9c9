import time

import pytest
from pyspark.sql import functions as F

from tickloom import views
from tickloom.operators import clean, windows
from tickloom.plans.features import build_features
from tickloom.streaming import jobs
from tickloom.streaming.windows import _PACKET, stateful_lookback_windows, windows_of

FEATS, TC, MC = ["logret_1d", "hl_spread"], ["target_7d"], ["mask_7d"]


def rows_of(df):
    return {
        (r["symbol"], r["label_date"]): (r["x"], r["m"], r["asset_id"], r["y"])
        for r in df.select("symbol", "label_date", "x", "m", "asset_id", "y").collect()
    }


@pytest.mark.parametrize("lookback", [1, 12])
def test_stream_windows_equal_batch_across_runs(spark, sf, tmp_path, lookback):
    panel = build_features(views.ticks(spark, sf), views.TICK_ORDER, [7]).where("date < '1995-06-01'")
    panel = panel.select("symbol", "date", "is_trading_day", "asset_id", *FEATS, *TC, *MC).cache()
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for lo, hi in (("1995-01-01", "1995-02-10"), ("1995-02-10", "1995-02-12"), ("1995-02-12", "1995-06-01")):
        panel.where((F.col("date") >= lo) & (F.col("date") < hi)).repartition(3).write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, panel.schema)
        q = jobs.append_parquet(stateful_lookback_windows(stream, lookback, FEATS, TC, MC), out, ck)
        q.awaitTermination()
    got = rows_of(spark.read.parquet(out))
    expected = rows_of(windows.lookback_windows(panel, lookback, FEATS, TC, MC, mode="trading"))
    assert spark.read.parquet(out).count() == len(got) == len(expected) > 0
    for k, (x, m, a, y) in expected.items():
        assert got[k][1:3] == (m, a) and got[k][3] == pytest.approx(y)
        flat = lambda v: [e if e is not None and e == e else None for row in v for e in row]
        assert flat(got[k][0]) == pytest.approx(flat(x))


def _packet(n: int):
    """One symbol's packet: two held rows, ``n`` new ones, windows of two rows at all but the first new row."""
    x = [float("nan") if i % 7 == 0 else float(i) for i in range(2 * (n + 2))]
    return ["a", list(range(n + 2)), x, [i % 3 > 0 for i in range(n + 2)], list(range(n + 2)), 2, [float(i) for i in range(n)], list(range(1, n)), [5] * (n - 1), []]


def test_long_packets_are_cut_in_linear_time(spark):
    def run(n):
        start = time.perf_counter()
        got = windows_of(spark.createDataFrame([_packet(n)], _PACKET), 2, 2, 1).orderBy("label_date").collect()
        return got, time.perf_counter() - start

    got, _ = run(50)
    step = lambda i: [None if v % 7 == 0 else float(v) for v in (2 * i, 2 * i + 1)]
    assert len(got) == 49 and [r["y"] for r in got] == [[float(i)] for i in range(1, 50)]
    assert [r["x"] for r in got] == [[step(i), step(i + 1)] for i in range(1, 50)]
    assert [r["m"] for r in got] == [[i % 3 > 0, (i + 1) % 3 > 0] for i in range(1, 50)]
    assert [(r["asset_id"], r["late_rows"], r["label_date"].toordinal() - 719163) for r in got] == [(i + 1, 5, i + 2) for i in range(1, 50)]
    got, took = run(12_000)
    assert len(got) == 11_999 and took < 20, "a step is looked up, not made again from the whole packet"


def test_late_rows_are_dropped_and_counted(spark, sf, tmp_path):
    panel = build_features(views.ticks(spark, sf), views.TICK_ORDER, [7]).where("date < '1995-03-01' and asset_id = 0")
    panel = panel.select("symbol", "date", "is_trading_day", "asset_id", *FEATS, *TC, *MC).cache()
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for part in (panel.where("date < '1995-02-01'"), panel.where("date >= '1995-01-30'")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, panel.schema)
        jobs.append_parquet(stateful_lookback_windows(stream, 5, FEATS, TC, MC), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("label_date").distinct().count()
    assert got.agg(F.max("late_rows")).first()[0] == 2


def test_ingest_and_clean_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    data = spark.range(10).select(F.lit("a").alias("symbol"), day.alias("date"), F.col("id").cast("string").alias("close"))
    for part in (data.where("id < 5"), data.where("id >= 5")):
        part.write.mode("append").parquet(src)
        jobs.stream_clean(jobs.read_files(spark, src, data.schema), clean.prep_stock, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["close"] for r in got.collect()) == [float(i) for i in range(10)]


def test_stream_scaler_accumulates(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    data = spark.range(10).select(F.col("id").cast("double").alias("v"), F.lit(3.0).alias("flat"))
    for part in (data.where("v < 5"), data.where("v >= 5")):
        part.write.mode("append").parquet(src)
        jobs.stream_scaler(jobs.read_files(spark, src, data.schema), ["v", "flat"], out, ck).awaitTermination()
    got = {r["feature"]: r for r in jobs.latest_scaler(spark, out).collect()}
    assert (got["v"]["mean"], got["v"]["n"]) == (4.5, 10) and got["v"]["std"] == pytest.approx(3.0276503541)
    assert got["flat"]["std"] == pytest.approx(1e-4)
