"""Column functions. Null is the only "missing": NaN and infinities are never kept as such."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schemas import EPS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    """True for a present, finite number; false (never null) otherwise."""
    x = _c(x).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def finite_or_null(x: Column | str) -> Column:
    return F.when(is_finite(x), _c(x))


def clamp_min(x: Column | str, low: float = EPS) -> Column:
    """Lower clamp that keeps null as null (``greatest`` alone would return the bound)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def safe_log(x: Column | str, low: float = EPS) -> Column:
    return F.ln(clamp_min(_c(x).cast("double"), low))


def positive_or_null(x: Column | str) -> Column:
    """A usable price: finite and above zero."""
    return F.when(is_finite(x) & (_c(x) > 0), _c(x))


def floor_day(x: Column | str) -> Column:
    """Calendar day of a date, naive or zoned timestamp."""
    return F.to_date(_c(x))


def expected_price(price: Column | str, logret: Column | str) -> Column:
    price = _c(price)
    return F.when(price > 0, price * F.exp(_c(logret)))


def simple_return(logret: Column | str) -> Column:
    return F.expm1(_c(logret))


def day_of_week(d: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_c(d))


def standardise(x: Column | str, mean: Column, std: Column, floor: float = 1e-12) -> Column:
    return (_c(x).cast("double") - mean) / F.greatest(std, F.lit(floor))
