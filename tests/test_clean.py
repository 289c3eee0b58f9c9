import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.functions import arrays, scalars
from tickloom.operators import aggregates, clean, unions
from tickloom.sources import ingest, sinks

D = dt.date
INF, NAN = float("inf"), float("nan")


def test_scalar_edges(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (-INF,), (0.0,), (-1.0,), (None,), (2.0,)], "v double")
    rows = df.select(
        scalars.is_finite("v").alias("ok"), scalars.positive_or_null("v").alias("p"), scalars.clamp_min("v").alias("c"),
        scalars.safe_log(scalars.finite_or_null("v")).alias("l"),
    ).collect()
    assert [r["ok"] for r in rows] == [False, False, False, True, True, False, True]
    assert [r["p"] for r in rows] == [None] * 6 + [2.0]
    assert rows[3]["c"] == rows[4]["c"] == 1e-6 and rows[5]["c"] is None
    assert rows[3]["l"] == pytest.approx(-13.815510558) and rows[5]["l"] is None


def test_lenient_cast_and_ensure(spark):
    df = spark.createDataFrame([("abc",), ("",), ("1.5",)], "x string")
    out = clean.lenient_cast(clean.ensure_columns(df, ["x", "y"]), ["x"], "double").collect()
    assert [r["x"] for r in out] == [None, None, 1.5] and all(r["y"] is None for r in out)


def test_align_to_schema(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2, 13), None, 7, None)], "date timestamp_ntz, a double, b int, t byte")
    schema = T.StructType.fromDDL("b long, date date, a float, missing int, s string, t byte")
    row = clean.align_to_schema(df, schema).first()
    assert tuple(row) == (7, D(2020, 1, 2), 0.0, 0, None, None)


def test_null_to_zero_and_finite(spark):
    df = spark.createDataFrame([(NAN, None), (1.0, 2)], "a double, b int")
    assert [tuple(r) for r in clean.null_to_zero(df).collect()] == [(0.0, 0), (1.0, 2)]
    inf = spark.createDataFrame([(INF,), (NAN,), (None,), (3.0,)], "a double")
    assert [r[0] for r in clean.finite_or_zero(inf, ["a"]).collect()] == [0.0, 0.0, 0.0, 3.0]


def test_prep_adds_casts_and_drops(spark):
    raw = spark.createDataFrame([("a", dt.datetime(2020, 1, 1, 5), "x", "2.5"), (None, None, "1", "1")], "symbol string, date timestamp_ntz, open string, close string")
    rows = clean.prep_crypto(raw).collect()
    assert len(rows) == 1 and rows[0]["open"] is None and rows[0]["close"] == 2.5
    assert rows[0]["date"] == D(2020, 1, 1) and rows[0]["num_trades"] is None and rows[0]["source"] == "crypto"


def test_lists(spark):
    df = spark.createDataFrame([(None,), ([],), ([1.0],), ([1.0, NAN, 3.0, 4.0],)], "v array<double>")
    padded = [list(r[0]) for r in df.select(arrays.clean_list("v", 3)).collect()]
    assert padded == [[0, 0, 0], [0, 0, 0], [1, 0, 0], [1, 0, 3]]
    assert [r[0] for r in df.select(arrays.finite_mean("v")).collect()] == pytest.approx([0, 0, 1, 8 / 3])


def test_union_keeps_first_seen_order(spark):
    a = spark.createDataFrame([("x", 1.0)], "symbol string, num_trades double")
    b = spark.createDataFrame([("y", 2.0)], "symbol string, other double")
    both = unions.union_prices(a, b, fill=True)
    assert both.columns == ["symbol", "num_trades", "other"]
    assert sorted(map(tuple, both.collect())) == [("x", 1.0, 0.0), ("y", 0.0, 2.0)]
    flipped = unions.union_prices(b, a, fill=True).select(both.columns)
    assert sorted(map(tuple, flipped.collect())) == sorted(map(tuple, both.collect()))


def test_daily_reduction_skips_missing(spark):
    rows = [("a", 3, 5.0, 9.0, None), ("a", 1, None, 7.0, None), ("a", 2, 4.0, 8.0, None)]
    t = spark.createDataFrame(rows, "symbol string, seq int, open double, close double, volume double")
    t = t.withColumn("date", F.lit("2020-01-01").cast("date"))
    r = aggregates.daily_ohlcv(t, ["seq"]).first()
    assert (r["open"], r["close"], r["volume"]) == (4.0, 9.0, 0.0)


def test_apply_by_key_splits_and_merges_in_order(spark):
    import pandas as pd

    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)

    def partial(key, pdf):
        assert len(pdf) <= 40
        return pd.DataFrame([(key[0], len(pdf), pdf["i"].iloc[0], pdf["i"].iloc[-1])], columns=["k", "n", "a", "b"])

    def merge(key, parts):
        ordered = bool((parts["a"].iloc[1:].to_numpy() == parts["b"].iloc[:-1].to_numpy() + 1).all())
        return pd.DataFrame([(key[0], parts["n"].sum(), ordered)], columns=["k", "n", "ordered"])

    out = aggregates.apply_by_key(df, ["k"], ["i"], partial, "k string, n long, a int, b int", merge, "k string, n long, ordered boolean", 40)
    assert sorted(map(tuple, out.collect())) == [("cold", 3, True), ("hot", 500, True)]


def test_pieces_keep_their_bound_inside_a_batch():
    batches = [pd.DataFrame({"k": ["a"] * 19 + ["b"] * 25 + ["c"] * 2}), pd.DataFrame({"k": ["c"] * 30})]
    pieces = [(g["k"].iloc[0], len(g)) for g in aggregates._runs(iter(batches), ["k"], 10)]
    assert max(n for _, n in pieces) == 10
    assert {k: sum(n for x, n in pieces if x == k) for k in "abc"} == {"a": 19, "b": 25, "c": 32}


def test_partial_results_are_folded_in_pieces(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise("cold").alias("k"), F.col("id").alias("v"))
    seen = []

    def combine(key, pdf):
        seen.append(len(pdf))
        return pd.DataFrame({"k": [key[0]], "total": [pdf["total"].sum()]})

    partial = lambda key, pdf: pd.DataFrame({"k": key[0], "total": pdf["v"]})  # one row in, one row out
    out = aggregates.apply_by_key(df, ["k"], ["v"], partial, "k string, total long", lambda key, pdf: pdf, "k string, total long", 100, combine)
    assert {r["k"]: r["total"] for r in out.collect()} == {"hot": sum(i for i in range(5000) if i % 4), "cold": sum(range(0, 5000, 4))}
    frames = [pd.DataFrame({"k": ["a"] * 250, "total": 1})]
    folded = list(aggregates._folded(aggregates._runs(iter(frames), ["k"], 100), ["k"], combine))
    assert folded[0]["total"].tolist() == [250] and max(seen) <= 101


def test_staging_keeps_missing_numbers_missing(spark, tmp_path, caplog):
    schema = T.StructType.fromDDL("id long, v float, n int, extra double")
    data = spark.createDataFrame([(1, 1.5, 3), (2, None, None), (3, NAN, 4), (None, 9.0, 9)], "id long, v double, n int")
    with caplog.at_level("WARNING"):
        assert ingest.append_staged(spark, lambda mark: data, "id", str(tmp_path / "t"), schema) == 3
    assert "1 rows without id" in caplog.text
    assert [tuple(r) for r in ingest.read_staged(spark, str(tmp_path / "t"), schema).orderBy("id").collect()] == [(1, 1.5, 3, None), (2, None, None, None), (3, None, 4, None)]


def test_reports(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 2), NAN)], "symbol string, date date, v double")
    r = aggregates.non_finite_report(df, ["v"]).first()
    assert (r["column"], r["n_bad"], r["first_date"]) == ("v", 1, D(2020, 1, 2))
    with pytest.raises(ValueError, match="v"):
        aggregates.require_finite(df, ["v"])


def test_append_staged_resumes_and_survives_a_torn_run(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, v float")
    path = str(tmp_path / "t")
    data = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    first = lambda mark: data.where("id < 4")
    assert ingest.append_staged(spark, first, "id", path, schema) == 4
    # data of an unfinished batch is invisible, then replaced
    data.limit(2).select("id", F.col("v").cast("float")).write.parquet(f"{path}/batch=00000001")
    assert ingest.read_staged(spark, path, schema).count() == 4
    assert ingest.append_staged(spark, lambda mark: data, "id", path, schema) == 6
    assert ingest.append_staged(spark, lambda mark: data, "id", path, schema) == 0
    assert sorted(r[0] for r in ingest.read_staged(spark, path, schema).collect()) == list(range(10))
    assert ingest.read_mark(spark, path) == (1, "9")


def test_required_and_cutoff(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing"):
        ingest.read_required(spark, str(tmp_path / "nothing"))
    df = spark.createDataFrame([(D(2020, 1, d),) for d in (1, 5, 9)], "date date")
    assert ingest.cutoff(df, "2020-01-09", 4).count() == 2


def test_topk_sink_skips_empty(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.5)], "symbol string, s double")
    path = str(tmp_path / "top")
    assert sinks.write_topk(df.where("s > 5"), "s", 2, "2020-01-01", path) == 0
    assert sinks.write_topk(df, "s", 2, "2020-01-01", path) == 2
    assert [r["symbol"] for r in spark.read.parquet(path).orderBy("symbol").collect()] == ["a", "b"]
    assert [r["symbol"] for r in sinks.topk_rows(df, "s", 1, "2020-01-01").collect()] == ["b"]


def test_declared_schemas():
    assert len(schemas.fx_schema().fields) == 172
    assert [len(s.fields) for s in (schemas.crypto_schema(), schemas.stock_schema(), schemas.weather_schema())] == [13, 7, 13]


def test_apply_by_key_query_makes_no_frame_per_day(spark, tmp_path, monkeypatch):
    from tickloom.catalog import context

    day = dt.datetime(2020, 1, 1)
    line = lambda key, supp, at, qty, price: (key, key, supp, 1, qty, price, 0.1, 0.1, "A", "O", at)
    rows = [line(1, 7, day, 2.0, 5.0), line(2, 7, day, 3.0, None), line(3, 7, None, 1.0, 8.0), line(4, 7, day + dt.timedelta(days=1), None, 9.0), line(5, 8, day, 4.0, 1.0)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    keyed, real = [], aggregates.apply_by_key
    monkeypatch.setattr(aggregates, "apply_by_key", lambda df, keys, *rest: keyed.append(keys) or real(df, keys, *rest, chunk_rows=2))
    out = {(r["symbol"], str(r["date"])): (r["n"], r["volume"], r["close"]) for r in context.d16(spark, str(tmp_path)).collect()}
    assert keyed == [["symbol"]]
    assert out == {("7", "2020-01-01"): (2, 5.0, None), ("7", "2020-01-02"): (1, 0.0, 9.0), ("7", "None"): (1, 1.0, 8.0), ("8", "2020-01-01"): (1, 4.0, 1.0)}
