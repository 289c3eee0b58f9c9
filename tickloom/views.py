"""Market views over the driver tables, which hold no market data of their own."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.aggregates import daily_ohlcv

#: Unique order of the ticks inside a day.
TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

# Order priorities that stand in for currencies.
CCY = {"1-URGENT": "c1", "2-HIGH": "c2", "3-MEDIUM": "c3", "4-NOT SPECIFIED": "c4", "5-LOW": "c5"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    price, bought = F.col("l_extendedprice"), F.col("l_returnflag") == "A"
    return t.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.col("l_quantity").alias("volume"),
        price.alias("quote_asset_volume"),
        F.lit(1.0).alias("num_trades"),
        F.when(bought, F.col("l_quantity")).otherwise(0.0).alias("taker_buy_base_vol"),
        F.when(bought, price).otherwise(0.0).alias("taker_buy_quote_vol"),
        F.col("l_discount").alias("closePctChange"),
        F.col("l_tax").alias("openPctChange"),
        F.when(F.col("l_linestatus") == "O", "crypto").otherwise("stock").alias("source"),
        *TICK_ORDER,
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_ohlcv(ticks(spark, sf_dir), TICK_ORDER)


def fx_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rate = {c: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(c) for p, c in CCY.items()}
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(*rate.values())


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("string").alias("station"),
        F.col("l_quantity").alias("tavg"),
        F.col("l_discount").alias("prcp"),
        F.col("l_tax").alias("wspd"),
        F.col("l_extendedprice").alias("pres"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("vec_id") % 365).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", day.alias("date"), F.slice("embedding", 1, 3).alias("sentiment"), F.col("embedding").alias("embeddings")
    )


def event_ticks(df: DataFrame) -> DataFrame:
    """Market shape of the events table, batch or streaming."""
    return df.select(
        "event_id",
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").alias("date"),
        *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"),
    )
