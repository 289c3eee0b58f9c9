"""Sources and sinks (A), projection and cleaning (B), unions (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import views
from tickloom.catalog.base import needs, query, rlist, rs, tidy
from tickloom.operators import clean, unions
from tickloom.operators.calendar import trading_day_flag
from tickloom.operators.joins import as_of_row, asset_dimension
from tickloom.plans.features import build_features
from tickloom.schemas import EPS
from tickloom.session import scratch_path, staged
from tickloom.sources import ingest, sinks

_PRICE = ["open", "high", "low", "close"]
_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.DateType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.FloatType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("flag", T.BooleanType()),
    ]
)


def _events_sql(missing: str) -> str:
    """The aligned events; ``missing`` stands for the two numbers that the table lacks."""
    return f"""SELECT event_id, CAST(ts AS DATE) AS ts, user_id, event_type, {rs('value::FLOAT', 'value')},
    CAST({missing} AS DOUBLE) AS rate, CAST({missing} AS INTEGER) AS level, value > 50 AS flag FROM events"""


def _flagged_events(spark, sf):
    return views.table(spark, sf, "events").withColumn("flag", F.col("value") > 50)


# --- A: sources and sinks ---------------------------------------------------------------


@query(
    "a1_ingest_incremental",
    f"""SELECT event_id, user_id, {rs('value')}, CASE WHEN event_id > (SELECT max(event_id) // 2 FROM events) THEN 2 ELSE 1 END AS run,
    max(event_id) OVER (PARTITION BY event_id > (SELECT max(event_id) // 2 FROM events)) AS mark FROM events""",
)
def a1(spark, sf):
    """Two runs: up to a mark, then everything newer."""
    e = views.table(spark, sf, "events")
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    mark1 = ingest.high_water_mark(ingest.ingest_incremental(e, "event_id", upto=half), "event_id")
    mark2 = ingest.high_water_mark(e, "event_id", mark1)
    first = ingest.ingest_incremental(e, "event_id", upto=mark1).withColumns({"run": F.lit(1), "mark": F.lit(mark1)})
    second = ingest.ingest_incremental(e, "event_id", mark1, mark2).withColumns({"run": F.lit(2), "mark": F.lit(mark2)})
    return tidy(first.unionByName(second).select("event_id", "user_id", "value", "run", "mark"))


@query(
    "a2_cutoff",
    f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, {rs('o_totalprice')} FROM orders
    WHERE o_orderdate <= (SELECT max(CAST(o_orderdate AS DATE)) - 30 FROM orders)""",
)
def a2(spark, sf):
    o = views.table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    last = o.agg(F.max("date")).first()[0]
    return tidy(ingest.cutoff(o, str(last), 30).select("o_orderkey", "date", "o_totalprice"))


@query("a3_source_projection", needs("ticks") + f"SELECT symbol, date, {rlist(*_PRICE, 'volume')} FROM ticks")
def a3(spark, sf):
    return tidy(ingest.project(views.ticks(spark, sf), ["symbol", "date", *_PRICE, "volume"]))


@query("a4_append_staged", _events_sql("NULL"))
def a4(spark, sf):
    """Half of the table is appended first, then the rest by resuming from the stored mark."""
    e = _flagged_events(spark, sf)
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    path = scratch_path(spark, "events")
    ingest.append_staged(spark, lambda mark: e.where(F.col("event_id") <= half), "event_id", path, _EVENT_SCHEMA)
    ingest.append_staged(spark, lambda mark: e.where(F.col("event_id") > int(mark)), "event_id", path, _EVENT_SCHEMA)
    return tidy(ingest.read_staged(spark, path, _EVENT_SCHEMA))


@query(
    "a4_append_staged_gaps",
    f"""SELECT event_id, CAST(ts AS DATE) AS date, {rs('CASE WHEN event_id % 5 > 1 THEN value END::FLOAT', 'close')}, event_id % 5 > 1 AS is_trading_day FROM events""",
)
def a4_gaps(spark, sf):
    """Missing and NaN closes are staged as missing, so their days are no trading days."""
    schema = T.StructType.fromDDL("event_id long, date date, close float")
    close = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 > 1, F.col("value"))
    rows = views.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"), close.alias("close"))
    path = scratch_path(spark, "gaps")
    ingest.append_staged(spark, lambda mark: rows, "event_id", path, schema)
    return tidy(trading_day_flag(ingest.read_staged(spark, path, schema)))


@query("d13_checked_append", f"SELECT event_id, {rs('value')} FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)")
def d13_append(spark, sf):
    """Two batches that are checked as they are written; the second one holds NaN and stays uncommitted."""
    schema = T.StructType.fromDDL("event_id long, value double")
    e = views.table(spark, sf, "events").select("event_id", "value")
    half = e.agg(F.expr("max(event_id) div 2")).first()[0]
    path = scratch_path(spark, "checked")
    ingest.append_staged(spark, lambda mark: e.where(F.col("event_id") <= half), "event_id", path, schema, finite=["value"])
    bad = e.where(F.col("event_id") > half).withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value")).otherwise(F.lit(float("nan"))))
    try:
        ingest.append_staged(spark, lambda mark: bad, "event_id", path, schema, finite=["value"])
    except ValueError:
        return tidy(ingest.read_staged(spark, path, schema))
    raise AssertionError("a batch with NaN was committed")


@query("a13_stored_bounds", needs("prices") + "SELECT min(date) AS first, max(date) AS last, count(*) AS n FROM prices")
def a13_stored(spark, sf):
    """Bounds and rows of a stored panel from the statistics of its files."""
    path = scratch_path(spark, "panel")
    clean.cluster_panel(views.prices(spark, sf)).write.parquet(path)
    return ingest.stored_bounds_table(spark, path)


@query(
    "f1_bucketed_panel",
    needs("prices")
    + f"""SELECT symbol, date, {rs('ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date)', 'logret')}, count(*) OVER (PARTITION BY symbol) AS n FROM prices""",
)
def f1_bucketed(spark, sf):
    """Windows on symbol from a bucketed panel, without an exchange."""
    path = scratch_path(spark, "bucketed")
    panel = clean.store_bucketed(views.prices(spark, sf), f"panel_{path[-32:]}", 8, path)
    w = Window.partitionBy("symbol").orderBy("date")
    log = F.ln("close")
    return tidy(panel.select("symbol", "date", (log - F.lag(log).over(w)).alias("logret"), F.count("*").over(Window.partitionBy("symbol")).alias("n")))


@query("a5_read_required", f"SELECT o_orderkey, {rs('o_totalprice')}, o_orderpriority FROM orders")
def a5(spark, sf):
    schema = T.StructType.fromDDL("o_orderkey long, o_totalprice double, o_orderpriority string")
    return tidy(ingest.read_required(spark, f"{sf}/orders.parquet", schema))


@query("a6_map_table", f"SELECT o_orderkey, {rs('o_totalprice * 2', 'doubled')} FROM orders")
def a6(spark, sf):
    fn = lambda df: df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))
    return tidy(ingest.map_table(spark, f"{sf}/orders.parquet", scratch_path(spark, "mapped"), fn))


@query(
    "a7_resolve_source",
    f"""SELECT kind, count(*) AS n, {rs('sum(o_totalprice)', 'total', 2)} FROM orders
    CROSS JOIN (SELECT unnest(['blank', 'call', 'path', 'select', 'table']) AS kind) GROUP BY kind""",
)
def a7(spark, sf):
    from tickloom.catalog.base import r

    path = f"{sf}/orders.parquet"
    views.table(spark, sf, "orders").createOrReplaceTempView("tickloom_orders")
    specs = {
        "blank": " ",
        "call": f"read_parquet('{path}')",
        "path": path,
        "select": "SELECT * FROM tickloom_orders",
        "table": "tickloom_orders",
    }
    parts = [ingest.resolve_source(spark, s, path).select(F.lit(k).alias("kind"), "o_totalprice") for k, s in specs.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("kind").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "a8_scan_panel",
    needs("prices")
    + f"""SELECT symbol, date, {rlist(*_PRICE)} FROM prices
    WHERE date BETWEEN DATE '1997-01-01' - 35 AND DATE '1999-12-31' + 30
    AND symbol IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)""",
)
def a8(spark, sf):
    from tickloom.operators.windows import scan_panel

    s = views.table(spark, sf, "supplier").where("s_acctbal > 0")
    listed = s.select(F.col("s_suppkey").cast("string").alias("symbol"))
    rows = scan_panel(views.prices(spark, sf), "1997-01-01", "1999-12-31", 30, 30, listed)
    return tidy(rows.select("symbol", "date", *_PRICE))


_LATEST = (
    needs("prices")
    + "SELECT symbol, date, close FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
)


def _latest(spark, sf):
    prices = views.prices(spark, sf)
    last = prices.agg(F.max("date")).first()[0]
    return as_of_row(prices, str(last)).select("symbol", "date", "close")


@query("a9_write_predictions_csv", f"SELECT symbol, CAST(date AS VARCHAR) AS date, {rs('close')} FROM ({_LATEST})")
def a9(spark, sf):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions_csv(_latest(spark, sf), path)
    return tidy(spark.read.option("header", True).schema("symbol string, date string, close double").csv(path))


@query(
    "a10_write_topk",
    f"SELECT symbol, date, {rs('close')}, DATE '2001-12-01' AS as_of FROM ({_LATEST}) ORDER BY close DESC, symbol DESC LIMIT 25",
)
def a10(spark, sf):
    path = scratch_path(spark, "topk")
    sinks.write_topk(_latest(spark, sf), "close", 25, "2001-12-01", path)
    return tidy(spark.read.schema("symbol string, date date, close double, as_of date").parquet(path))


@query("a11_feature_meta", needs("ids") + "SELECT symbol, asset_id, 'close' AS feature, CAST(30 AS INTEGER) AS lookback FROM ids")
def a11(spark, sf):
    path = scratch_path(spark, "meta")
    assets, _ = asset_dimension(views.ticks(spark, sf))
    scaler = spark.createDataFrame([("close", 0.0, 1.0, 1)], "feature string, mean double, std double, n long")
    sinks.save_feature_meta(sinks.FeatureMeta(["close"], [7, 30], 30, "close"), scaler, assets, path)
    meta, scaler, assets = sinks.load_feature_meta(spark, path)
    return assets.withColumns({"feature": F.lit(meta.features[0]), "lookback": F.lit(meta.lookback)})


@query("a13_distinct_symbols", needs("ticks") + "SELECT DISTINCT symbol FROM ticks ORDER BY symbol")
def a13(spark, sf):
    return ingest.distinct_symbols(views.ticks(spark, sf))


@query("a13_date_bounds", needs("ticks") + "SELECT min(date) AS min_date, max(date) AS max_date FROM ticks")
def a13b(spark, sf):
    return ingest.date_bounds_table(views.ticks(spark, sf))


# --- B: projection and cleaning ---------------------------------------------------------


@query("b2_ensure_columns", "SELECT event_id, CAST(NULL AS FLOAT) AS high, CAST(NULL AS FLOAT) AS low FROM events")
def b2(spark, sf):
    return clean.ensure_columns(views.table(spark, sf, "events"), ["event_id", "high", "low"]).select("event_id", "high", "low")


@query(
    "b3_lenient_cast",
    f"SELECT event_id, {rs('TRY_CAST(substr(props, 7, 2) AS DOUBLE)', 'k')}, TRY_CAST(event_type AS INTEGER) AS t FROM events",
)
def b3(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", F.substring("props", 7, 2).alias("k"), F.col("event_type").alias("t"))
    return tidy(clean.lenient_cast(clean.lenient_cast(e, ["k"], "double"), ["t"], "int"))


@query("b4_align_to_schema", _events_sql("0"))
def b4(spark, sf):
    return tidy(clean.align_to_schema(_flagged_events(spark, sf), _EVENT_SCHEMA))


@query("b5_floor_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def b5(spark, sf):
    from tickloom.functions.scalars import floor_day

    return views.table(spark, sf, "events").select("event_id", floor_day("ts").alias("day"))


@query("b6_drop_null_keys", "SELECT event_id, event_type AS symbol, CAST(ts AS DATE) AS date FROM events WHERE event_type <> 'error'")
def b6(spark, sf):
    e = views.table(spark, sf, "events")
    kept = F.when(F.col("event_type") != "error", F.col("event_type"))
    return clean.drop_null_keys(e.select("event_id", kept.alias("symbol"), F.to_date("ts").alias("date")))


@query("b7_tag_source", "SELECT event_id, 'stock' AS source FROM events")
def b7(spark, sf):
    return clean.tag_source(views.table(spark, sf, "events").select("event_id"), "stock")


_EVENT_TICKS = "SELECT event_id, CAST(user_id AS VARCHAR) AS symbol, ts AS date, value::FLOAT AS v FROM events"


@query(
    "b8_prep_stock",
    f"""SELECT symbol, CAST(date AS DATE) AS date, {rs('v', 'open')}, {rs('v', 'close')}, {rs('v', 'high')}, {rs('v', 'low')},
    CAST(NULL AS DOUBLE) AS volume, 'stock' AS source FROM ({_EVENT_TICKS})""",
)
def b8(spark, sf):
    raw = views.event_ticks(views.table(spark, sf, "events")).drop("volume")
    return tidy(clean.prep_stock(raw))


_CRYPTO = ["volume", "quote_asset_volume", "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol", "closePctChange", "openPctChange"]


@query(
    "b9_prep_crypto",
    needs("ticks")
    + f"SELECT symbol, date, {', '.join(rs(f'{c}::FLOAT', c) for c in ['open', 'close', 'high', 'low', *_CRYPTO])}, 'crypto' AS source FROM ticks",
)
def b9(spark, sf):
    return tidy(clean.prep_crypto(views.ticks(spark, sf).drop("source")))


@query(
    "b10_null_to_zero",
    f"""SELECT event_id, {rs("CASE WHEN event_type IN ('error', 'click') THEN 0.0 ELSE value END", 'v')},
    CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS u, CASE WHEN event_type <> 'error' THEN event_type END AS t FROM events""",
)
def b10(spark, sf):
    t = F.col("event_type")
    e = views.table(spark, sf, "events").select(
        "event_id",
        F.when(t == "click", F.lit(float("nan"))).when(t != "error", F.col("value")).alias("v"),
        F.when(t != "error", F.col("user_id")).alias("u"),
        F.when(t != "error", t).alias("t"),
    )
    return tidy(clean.null_to_zero(e))


@query(
    "b11_finite_or_zero",
    f"SELECT event_id, {rs('CASE WHEN event_type IN (' + chr(39) + 'error' + chr(39) + ', ' + chr(39) + 'click' + chr(39) + ') THEN 0.0 ELSE value::FLOAT END', 'v')} FROM events",
)
def b11(spark, sf):
    t = F.col("event_type")
    bad = F.when(t == "click", F.lit(float("nan"))).when(t == "error", F.lit(float("-inf"))).otherwise(F.col("value"))
    return tidy(clean.finite_or_zero(views.table(spark, sf, "events").select("event_id", bad.alias("v")), ["v"]))


@query(
    "b12_clamp_min",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {rs('l_extendedprice')},
    {rs("CASE WHEN l_returnflag <> 'R' THEN greatest(l_discount, 1e-6) END", 'd', 7)} FROM lineitem""",
)
def b12(spark, sf):
    from tickloom.catalog.base import r
    from tickloom.functions.scalars import clamp_min

    d = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    t = views.table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("l_extendedprice")).alias("l_extendedprice"), r(clamp_min(d, EPS), 7).alias("d"))


@query("b13_positive_or_null", f"SELECT event_id, {rs('CASE WHEN value - 10 > 0 THEN value - 10 END', 'v')} FROM events")
def b13(spark, sf):
    from tickloom.functions.scalars import positive_or_null

    return tidy(views.table(spark, sf, "events").select("event_id", positive_or_null(F.col("value") - 10).alias("v")))


@query(
    "b14_select_features",
    needs("targeted")
    + f"""SELECT {rlist(*_PRICE, *_CRYPTO)}, is_trading_day,
    {rlist('logret_1d', 'logret_7d', 'logret_30d', 'vol_1d', 'vol_7d', 'vol_30d', 'mom_1d', 'mom_7d', 'mom_30d', 'hl_spread')},
    dow, dom, month, asset_id FROM targeted""",
)
def b14(spark, sf):
    panel = build_features(views.ticks(spark, sf), views.TICK_ORDER, [7, 30])
    return tidy(clean.select_features(panel))


@query("b16_prefix_columns", f"SELECT date, {rs('l_quantity', 'wx_tavg')}, {rs('l_discount', 'wx_prcp')} FROM (SELECT *, CAST(l_shipdate AS DATE) AS date FROM lineitem)")
def b16(spark, sf):
    return tidy(clean.prefix_columns(views.weather(spark, sf).select("date", "tavg", "prcp"), "wx_"))


# --- G: unions --------------------------------------------------------------------------

_STOCKISH = "SELECT symbol, date, open, close, NULL::DOUBLE AS num_trades, source FROM ticks WHERE source = 'stock'"
_CRYPTOISH = "SELECT symbol, date, open, close, num_trades, source FROM ticks WHERE source = 'crypto'"


def _both(spark, sf):
    t = views.ticks(spark, sf)
    return (
        t.where("source = 'stock'").select("symbol", "date", "open", "close", "source"),
        t.where("source = 'crypto'").select("symbol", "date", "open", "close", "num_trades", "source"),
    )


@query(
    "g1_union_prices",
    needs("ticks") + f"SELECT symbol, date, {rlist('open', 'close')}, {rs('coalesce(num_trades, 0)', 'num_trades')}, source FROM ({_STOCKISH} UNION ALL {_CRYPTOISH})",
)
def g1(spark, sf):
    stock, crypto = _both(spark, sf)
    return tidy(unions.union_prices(stock, crypto, fill=True))


@query(
    "g1_union_keep_missing",
    needs("ticks") + f"SELECT symbol, date, {rlist('open', 'close', 'num_trades')}, source FROM ({_STOCKISH} UNION ALL {_CRYPTOISH})",
)
def g1b(spark, sf):
    return tidy(unions.union_prices(*_both(spark, sf)))


@query(
    "g2_union_panel_fx",
    needs("prices", "fxret")
    + f"""SELECT symbol, date, {rs('close')}, CAST(0 AS DOUBLE) AS eur_fx_logret FROM prices
    UNION ALL SELECT NULL, date, CAST(0 AS DOUBLE), {rs('eur_fx_logret')} FROM fxret""",
)
def g2(spark, sf):
    from tickloom.operators.dims import fx_log_return

    panel = views.prices(spark, sf).select("symbol", "date", "close")
    return tidy(unions.union_panel_fx(panel, fx_log_return(views.fx_wide(spark, sf))))


@query(
    "g3_union_folds",
    needs("prices")
    + f"""SELECT symbol, {rs('max(close)', 'score')}, CAST(1 AS INTEGER) AS fold FROM prices GROUP BY symbol
    UNION ALL SELECT symbol, {rs('min(close)', 'score')}, 2 FROM prices GROUP BY symbol""",
)
def g3(spark, sf):
    p = staged(views.prices(spark, sf).select("symbol", "close"), "prices")
    folds = [p.groupBy("symbol").agg(f("close").alias("score")) for f in (F.max, F.min)]
    return tidy(unions.union_folds(folds))
