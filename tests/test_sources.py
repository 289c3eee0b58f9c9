import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import views
from tickloom.operators import clean
from tickloom.sources import feed, ingest
from tickloom.streaming import jobs, windows

D = dt.date


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- id feed ------------------------------------------------------------------------------


def feed_of(spark, path, **options):
    feed.register(spark)
    reader = spark.read.format("id_feed").option("path", str(path)).option("key", "id")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_ranges_hold_every_id_once(spark, tmp_path):
    # ids far apart and in any order over the files, one id twice, some rows without an id
    ids = [i * i * i for i in range(200)] + [10**15, 8, None, None]
    rows = spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").repartition(7)
    rows.write.option("parquet.block.size", 1024).parquet(str(tmp_path / "t"))
    ranges = feed.IdRanges({"path": str(tmp_path / "t"), "key": "id", "range_rows": "10"})
    for after in (feed.NOTHING, -5, 0, 1000, 10**15 - 1):
        parts = ranges.ranges(after)
        assert parts[0].low == after and parts[-1].high == 10**15 and all(a.high == b.low for a, b in zip(parts, parts[1:]))
    assert 10 < len(ranges.ranges(-5)) < 200 and ranges.ranges(10**15) == []
    for after in (feed.NOTHING, 0, 343, 10**15):
        got = sorted(r["id"] for r in feed_of(spark, tmp_path / "t", range_rows=10, after=after).collect())
        assert got == sorted(i for i in ids if i is not None and i > after)
    assert feed_of(spark, tmp_path / "t", range_rows=10).rdd.getNumPartitions() > 10


def test_feed_of_no_rows_and_of_files_without_statistics(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "t").mkdir()
    pq.write_table(pa.table({"id": pa.array([3, 1, 2]), "v": ["c", "a", "b"]}), tmp_path / "t" / "a.parquet", write_statistics=False)
    assert sorted(map(tuple, feed_of(spark, tmp_path / "t", after=1).collect())) == [(2, "b"), (3, "c")]
    spark.createDataFrame([], "id long, v string").write.parquet(str(tmp_path / "none"))
    assert feed_of(spark, tmp_path / "none").count() == 0


def test_stream_of_ids_goes_on_after_a_restart(spark, tmp_path):
    feed.register(spark)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    data = spark.range(0, 100).select("id", (F.col("id") * 2).alias("v"))
    for upto, part in ((40, data.where("id < 40")), (100, data.where("id >= 40")), (100, None)):
        if part is not None:
            part.write.mode("append").parquet(src)
        stream = spark.readStream.format("id_feed").option("path", src).option("key", "id").option("range_rows", 16).load()
        jobs.append_parquet(stream, out, ck).awaitTermination()
        got = spark.read.schema("id long, v long").parquet(out)
        assert got.count() == got.distinct().count() == upto


# --- checks in flight ---------------------------------------------------------------------

SCHEMA = T.StructType().add("id", T.LongType()).add("v", T.DoubleType())


def test_append_reads_its_source_once_and_keeps_bad_batches_out(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(rows):
        def pass_on(batches):
            for b in batches:
                reads.add(len(b))
                yield b

        return spark.createDataFrame(rows, "id long, v double").coalesce(1).mapInPandas(pass_on, "id long, v double")

    path = str(tmp_path / "t")
    good = [(i, float(i)) for i in range(10)] + [(None, float("nan"))]
    assert ingest.append_staged(spark, lambda mark: counted(good), "id", path, SCHEMA, finite=["v"]) == 10
    assert reads.value == 11 and ingest.read_mark(spark, path) == (0, "9")
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="uncommitted.*'v': 1"):
            ingest.append_staged(spark, lambda mark: counted([(11, 1.0), (12, bad)]), "id", path, SCHEMA, finite=["v"])
        assert ingest.read_staged(spark, path, SCHEMA).count() == 10
    # the repaired batch takes the folder of the bad one
    assert ingest.append_staged(spark, lambda mark: counted([(11, 1.0), (12, 2.0), (3, 9.0)]), "id", path, SCHEMA, finite=["v"]) == 2
    assert sorted(r["id"] for r in ingest.read_staged(spark, path, SCHEMA).collect()) == [*range(10), 11, 12]
    assert ingest.append_staged(spark, lambda mark: counted([]), "id", path, SCHEMA) == 0
    assert ingest.append_staged(spark, lambda mark: counted([(None, 1.0)]), "id", path, SCHEMA) == 0


def test_append_still_filters_in_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "src"))
    seen = []

    def source(mark):
        df = spark.read.parquet(str(tmp_path / "src"))
        seen.append(df)
        return df if mark else df.where("id < 50")

    assert [ingest.append_staged(spark, source, "id", str(tmp_path / "t"), SCHEMA) for _ in range(3)] == [50, 50, 0]


def test_finite_tables_replace_each_other_and_bad_ones_do_not(spark, tmp_path):
    path = str(tmp_path / "panel")
    good = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, v double")
    assert ingest.write_finite(good, path, ["v"]) == 2 and ingest.write_finite(good.limit(1), path, ["v"]) == 1
    with pytest.raises(ValueError, match="'v': 1"):
        ingest.write_finite(good.withColumn("v", F.when(F.col("id") == 1, F.col("v"))), path, ["id", "v"])
    assert spark.read.parquet(path).count() == 1 and not (tmp_path / "panel.pending").exists()
    assert ingest.write_finite(good.where("false"), path, ["v"]) == 0 and spark.read.parquet(path).count() == 0


# --- stored panels ------------------------------------------------------------------------


def test_bounds_come_from_file_statistics(spark, sf, tmp_path):
    prices = views.prices(spark, sf)
    clean.cluster_panel(prices, 3).write.parquet(str(tmp_path / "panel"))
    told = ingest.stored_bounds_table(spark, str(tmp_path / "panel"))
    assert "PushedAggregation: [MIN(date), MAX(date), COUNT(*)]" in plan(told).replace("1)", "*)")
    want = prices.agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert ingest.stored_bounds(spark, str(tmp_path / "panel")) == tuple(want)
    prices.where("false").write.parquet(str(tmp_path / "none"))
    assert ingest.stored_bounds(spark, str(tmp_path / "none")) == (None, None, 0)
    assert "FileScan parquet" in plan(spark.read.parquet(str(tmp_path / "panel"))), "other reads keep their reader"


def test_bucketed_panels_need_no_exchange(spark, sf, tmp_path):
    prices = views.prices(spark, sf).where("symbol != '3' OR date < '1996-01-01'")
    odd = spark.createDataFrame([(None, D(2020, 1, 1), 1.0), ("1", None, 1.0)], "symbol string, date date, close double")
    panel = clean.store_bucketed(prices.unionByName(odd, allowMissingColumns=True), "bucketed_test", 4, str(tmp_path / "b"))
    try:
        last = panel.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))).groupBy("symbol").agg(F.max("n").alias("n"))
        both = last.join(panel.groupBy("symbol").agg(F.max("close").alias("top")), "symbol")
        shuffles = [x for x in plan(both).split("\n") if "Exchange hashpartitioning" in x]
        assert not shuffles and "Bucketed: true" in plan(both)
        want = {r["symbol"]: r["n"] for r in prices.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
        want["1"] = want.get("1", 0) + 1
        assert {r["symbol"]: r["n"] for r in both.collect()} == want
        assert panel.count() == prices.count() + 2
    finally:
        spark.sql("DROP TABLE bucketed_test")


# --- streaming windows --------------------------------------------------------------------


def test_late_rows_are_told_even_without_a_window(spark, tmp_path):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    schema = "symbol string, date date, is_trading_day boolean, asset_id int, x double, y double, ok int"

    def rows(symbol, which, y=1.0):
        return [(symbol, days[i], True, None if symbol == "b" else 1, float(i), y, 1) for i in which]

    src, out, late, ck = (str(tmp_path / n) for n in ("src", "out", "late", "ck"))
    slices = [
        rows("a", range(10)) + rows("b", range(2)) + rows("a", [4]) + rows(None, [1]) + [("a", None, True, 1, 0.0, 1.0, 1)],
        rows("a", range(8, 11)) + rows("b", [0, 1]),
        *[rows("a", [i]) for i in range(11, 22)],
        rows("a", [3], None),
    ]
    for part in slices:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, spark.createDataFrame([], schema).schema)
        windows.write_windows(stream, 3, ["x"], ["y"], ["ok"], out, late, ck).awaitTermination()
    got = windows.read_batches(spark, late).groupBy("symbol").agg(F.sort_array(F.collect_list("date")).alias("d"))
    assert {r["symbol"]: r["d"] for r in got.collect()} == {"a": [days[3], days[4], days[8], days[9]], "b": [days[0], days[1]]}
    found = {r["label_date"]: r for r in windows.read_batches(spark, out).collect()}
    assert sorted(found) == days[3:22]
    for i in range(3, 22):
        r = found[days[i]]
        assert [v[0] for v in r["x"]] == [i - 3, i - 2, i - 1] and r["m"] == [True] * 3 and r["asset_id"] == 1 and r["y"] == [1.0]
    assert found[days[21]]["late_rows"] == 3 and found[days[3]]["late_rows"] == 0
