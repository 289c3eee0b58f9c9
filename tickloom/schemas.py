"""Declared schemas. Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

DATE, SYMBOL = "date", "symbol"

#: Lower clamp for prices and rates before a logarithm.
EPS = 1e-6

# Column names of the price collections.
PRICE_COLS = ["open", "high", "low", "close"]
ACTIVITY_COLS = ["volume", "quote_asset_volume", "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol"]
CHANGE_COLS = ["closePctChange", "openPctChange"]
WEATHER_COLS = ["tavg", "tmin", "tmax", "prcp", "snow", "wdir", "wspd", "wpgt", "pres", "tsun"]

# Embedding length of a headline.
EMBEDDING_DIM = 512

# Currency codes of the wide rate table.
CURRENCIES = (
    "AED", "AFN", "ALL", "AMD", "ANG", "AOA", "ARS", "AUD", "AWG", "AZN", "BAM", "BBD", "BDT", "BGN", "BHD", "BIF",
    "BMD", "BND", "BOB", "BRL", "BSD", "BTC", "BTN", "BWP", "BYN", "BYR", "BZD", "CAD", "CDF", "CHF", "CLF", "CLP",
    "CNY", "CNH", "COP", "CRC", "CUC", "CUP", "CVE", "CZK", "DJF", "DKK", "DOP", "DZD", "EGP", "ERN", "ETB", "EUR",
    "FJD", "FKP", "GBP", "GEL", "GGP", "GHS", "GIP", "GMD", "GNF", "GTQ", "GYD", "HKD", "HNL", "HRK", "HTG", "HUF",
    "IDR", "ILS", "IMP", "INR", "IQD", "IRR", "ISK", "JEP", "JMD", "JOD", "JPY", "KES", "KGS", "KHR", "KMF", "KPW",
    "KRW", "KWD", "KYD", "KZT", "LAK", "LBP", "LKR", "LRD", "LSL", "LTL", "LVL", "LYD", "MAD", "MDL", "MGA", "MKD",
    "MMK", "MNT", "MOP", "MRU", "MUR", "MVR", "MWK", "MXN", "MYR", "MZN", "NAD", "NGN", "NIO", "NOK", "NPR", "NZD",
    "OMR", "PAB", "PEN", "PGK", "PHP", "PKR", "PLN", "PYG", "QAR", "RON", "RSD", "RUB", "RWF", "SAR", "SBD", "SCR",
    "SDG", "SEK", "SGD", "SHP", "SLE", "SLL", "SOS", "SRD", "STD", "SVC", "SYP", "SZL", "THB", "TJS", "TMT", "TND",
    "TOP", "TRY", "TTD", "TWD", "TZS", "UAH", "UGX", "USD", "UYU", "UZS", "VES", "VND", "VUV", "WST", "XAF", "XAG",
    "XAU", "XCD", "XDR", "XOF", "XPF", "YER", "ZAR", "ZMK", "ZMW", "ZWL",
)

# Horizon labels and their calendar-day offsets.
HORIZON_DAYS = {"1w": 7, "1m": 30, "6m": 182, "1y": 365}

# The same labels for horizons in trading days.
TRADING_DAYS = {"1w": 5, "1m": 21, "6m": 126, "1y": 252}


def _table(keys: dict[str, T.DataType], measures: list[str], bits: int) -> T.StructType:
    number = T.FloatType() if bits == 32 else T.DoubleType()
    fields = [T.StructField(n, t) for n, t in keys.items()]
    return T.StructType(fields + [T.StructField(m, number) for m in measures])


def stock_schema(bits: int = 32) -> T.StructType:
    return _table({DATE: T.DateType(), SYMBOL: T.StringType()}, [*PRICE_COLS, "volume"], bits)


def crypto_schema(bits: int = 32) -> T.StructType:
    return _table({DATE: T.DateType(), SYMBOL: T.StringType()}, [*PRICE_COLS, *ACTIVITY_COLS, *CHANGE_COLS], bits)


def weather_schema(bits: int = 32) -> T.StructType:
    keys = {DATE: T.DateType(), "country": T.StringType(), "station": T.StringType()}
    return _table(keys, WEATHER_COLS, bits)


def fx_schema(bits: int = 32) -> T.StructType:
    return _table({DATE: T.DateType(), "base_currency": T.StringType()}, list(CURRENCIES), bits)


def news_schema() -> T.StructType:
    floats = T.ArrayType(T.FloatType())
    return T.StructType(
        [
            T.StructField(DATE, T.DateType()),
            T.StructField("headline", T.StringType()),
            T.StructField("sentiment", floats),
            T.StructField("embeddings", floats),
        ]
    )


def scaler_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("feature", T.StringType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("std", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )
