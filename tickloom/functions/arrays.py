"""Element functions on list columns, as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalars import _c, is_finite


def clean_list(x: Column | str, length: int | None = None) -> Column:
    """Cast elements to float (unparsable, missing and non-finite become 0) and, when
    ``length`` is given, cut or zero-pad to it. A missing list becomes empty or all zero."""
    as_float = F.transform(_c(x), lambda e: F.when(is_finite(e.try_cast("float")), e.try_cast("float")))
    filled = F.transform(as_float, lambda e: F.coalesce(e, F.lit(0.0).cast("float")))
    filled = F.coalesce(filled, F.array().cast("array<float>"))
    if length is None:
        return filled
    return pad_list(filled, length)


def pad_list(x: Column | str, length: int) -> Column:
    x = _c(x)
    padded = F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), length))
    return F.slice(padded, 1, length)


def finite_mean(x: Column | str) -> Column:
    """Mean of the finite elements; 0 for a missing list or one without any."""
    kept = F.filter(_c(x), lambda e: is_finite(e))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, e: acc + e.cast("double"))
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))
