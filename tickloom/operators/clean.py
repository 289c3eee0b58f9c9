"""Projection, schema alignment and cleaning of raw price tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import finite_or_null, floor_day, is_finite
from tickloom.schemas import ACTIVITY_COLS, CHANGE_COLS, DATE, PRICE_COLS, SYMBOL

_FRACTIONS = (T.FloatType, T.DoubleType)
_FILLED_INTS = (T.IntegerType, T.LongType)


def ensure_columns(df: DataFrame, names: list[str], dtype: str = "float") -> DataFrame:
    """Add absent columns as missing values."""
    absent = [n for n in names if n not in df.columns]
    return df.select("*", *[F.lit(None).cast(dtype).alias(n) for n in absent])


def lenient_cast(df: DataFrame, cols: list[str], dtype: str) -> DataFrame:
    """Cast, turning what does not parse into null."""
    return df.withColumns({c: F.col(c).try_cast(dtype) for c in cols})


def align_to_schema(df: DataFrame, schema: T.StructType, fill: bool = True) -> DataFrame:
    """Select exactly ``schema``: floats and 32/64-bit ints are cast and filled with 0, days are
    floored, strings cast. Narrow ints, booleans and lists pass through uncast and unfilled.

    Without ``fill``, missing numbers stay null and NaN and infinities become null, so a missing
    close is not mistaken for a traded one."""

    def field(f: T.StructField) -> Column:
        kind = type(f.dataType)
        if f.name not in df.columns:
            col = F.lit(None).cast(f.dataType)
            filled = fill and kind in _FRACTIONS + _FILLED_INTS
            return (F.coalesce(col, F.lit(0).cast(f.dataType)) if filled else col).alias(f.name)
        col = F.col(f.name)
        if kind in (T.DateType, T.TimestampType, T.TimestampNTZType):
            return floor_day(col).cast(f.dataType).alias(f.name)
        if kind in _FRACTIONS + _FILLED_INTS and not fill:
            number = col.try_cast(f.dataType)
            return (finite_or_null(number) if kind in _FRACTIONS else number).alias(f.name)
        if kind in _FRACTIONS + _FILLED_INTS:
            return F.coalesce(col.try_cast(f.dataType), F.lit(0).cast(f.dataType)).alias(f.name)
        if kind is T.StringType:
            return col.cast("string").alias(f.name)
        return col

    return df.select(*[field(f) for f in schema])


def drop_null_keys(df: DataFrame, keys: list[str] = [DATE, SYMBOL]) -> DataFrame:
    return df.dropna(subset=list(keys))


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))


def _prep(df: DataFrame, measures: list[str], source: str, order_cols: list[str]) -> DataFrame:
    """One projection: add what is missing, floor the day, cast, drop rows without key.

    ``order_cols`` are kept as they are: they tell first from last inside a day later on."""
    present = ensure_columns(df, [DATE, SYMBOL, *measures])
    cleaned = present.select(
        F.col(SYMBOL).cast("string").alias(SYMBOL),
        floor_day(DATE).alias(DATE),
        *[finite_or_null(F.col(c).try_cast("float")).alias(c) for c in measures],
        F.lit(source).alias("source"),
        *order_cols,
    )
    return drop_null_keys(cleaned)


def prep_stock(df: DataFrame, order_cols: list[str] = []) -> DataFrame:
    return _prep(df, ["open", "close", "high", "low", "volume"], "stock", order_cols)


def prep_crypto(df: DataFrame, order_cols: list[str] = []) -> DataFrame:
    return _prep(df, ["open", "close", "high", "low", *ACTIVITY_COLS, *CHANGE_COLS], "crypto", order_cols)


def _numeric(df: DataFrame, kinds=T.NumericType) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def null_to_zero(df: DataFrame) -> DataFrame:
    """NaN becomes null, then every numeric null becomes 0.

    Opt-in: it erases the difference between a missing close and a close of 0, from which
    the trading-day flag is derived.
    """
    fills = {}
    for c in _numeric(df):
        col = F.col(c)
        if isinstance(df.schema[c].dataType, _FRACTIONS):
            col = F.when(F.isnan(col), None).otherwise(col)
        fills[c] = F.coalesce(col, F.lit(0).cast(df.schema[c].dataType))
    return df.withColumns(fills) if fills else df


def finite_or_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(is_finite(c), F.col(c)).otherwise(F.lit(0.0)).cast("float") for c in cols})


def feature_columns(df: DataFrame, fixed: list[str] | None = None, prefixes: tuple[str, ...] = ()) -> list[str]:
    """Names of the feature columns.

    Without ``fixed``: everything but keys, source, targets and masks, in column order.
    With it: that list, then the columns that start with one of ``prefixes``.
    """
    if fixed is not None:
        return [*fixed, *[c for c in df.columns if c.startswith(prefixes)]] if prefixes else list(fixed)
    return [c for c in df.columns if c not in (SYMBOL, DATE, "source") and not c.startswith(("target_", "mask_"))]


def feature_roles(features: list[str], fx: tuple[str, ...] = ("eur_fx_logret",)) -> dict[str, list[str]]:
    return {"price": [c for c in features if c not in fx], "fx": [c for c in features if c in fx]}


def select_features(df: DataFrame, **how) -> DataFrame:
    return df.select(*feature_columns(df, **how))


def prefix_columns(df: DataFrame, prefix: str, keep: list[str] = [DATE]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def cluster_panel(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Panel laid out in (symbol, date) order for storage.

    Ranges are cut on both keys, so a symbol with much data spans several partitions.
    """
    args = (SYMBOL, DATE) if partitions is None else (partitions, SYMBOL, DATE)
    return df.repartitionByRange(*args).sortWithinPartitions(SYMBOL, DATE)


def store_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Panel kept as ``table``, dealt into ``buckets`` by symbol and sorted by (symbol, date); the table, read again.

    Windows, aggregates and joins on symbol start from it without an exchange. A bucket is one file; a symbol has at
    most as many rows as the calendar has days, so buckets differ by what their symbols differ in number.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, SYMBOL)
    writer = dealt.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, SYMBOL).sortBy(SYMBOL, DATE)
    (writer.option("path", path) if path is not None else writer).saveAsTable(table)
    return spark.table(table)


__all__ = [
    "PRICE_COLS", "align_to_schema", "cluster_panel", "drop_null_keys", "ensure_columns", "feature_columns",
    "feature_roles", "finite_or_zero", "lenient_cast", "null_to_zero", "prefix_columns", "prep_crypto",
    "prep_stock", "select_features", "store_bucketed", "tag_source",
]
