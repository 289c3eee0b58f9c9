"""Lookback windows. The panel has one row per (symbol, date); rows are calendar days after
densification. All windows of one call share a single exchange and sort on (symbol, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import finite_or_null, is_finite, positive_or_null
from tickloom.operators.calendar import by_symbol, fill_gaps, so_far, whole
from tickloom.operators.clean import ensure_columns
from tickloom.schemas import DATE, SYMBOL
from tickloom.session import size_checked

def _row(features: list[str]) -> Column:
    """One time step as an array; a missing feature stays a null element."""
    return F.array(*[F.col(c).cast("float") for c in features])


def _complete(features: list[str]) -> Column:
    ok = F.lit(True)
    for c in features:
        ok = ok & is_finite(c)
    return ok


def _before(lookback: int, over: WindowSpec | None = None) -> WindowSpec:
    return (over or by_symbol()).rowsBetween(-lookback, -1)


def valid_labels(
    panel: DataFrame,
    lookback: int,
    step_ok: Column,
    targets: list[str],
    masks: list[str],
    require_all: bool = True,
) -> DataFrame:
    """Panel with ``_valid``: the row is the label of an accepted window of earlier rows."""
    n_targets = sum((is_finite(c).cast("int") for c in targets), F.lit(0))
    if require_all:
        n_masks = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in masks), F.lit(0))
        labelled = (n_targets == len(targets)) & (n_masks >= len(targets))
    else:
        labelled = n_targets > 0
    flagged = panel.withColumn("_ok", step_ok)
    # valid steps in the window = difference of two running counts, whatever its length
    counted = flagged.withColumns(
        {"_seen": F.sum(F.col("_ok").cast("long")).over(so_far()), "_rn": F.row_number().over(by_symbol())}
    )
    inside = F.lag("_seen", 1, 0).over(by_symbol()) - F.lag("_seen", lookback + 1, 0).over(by_symbol())
    return counted.withColumn("_valid", (F.col("_rn") > lookback) & (inside > 0) & labelled).drop("_seen", "_rn")


def _step_ok(features: list[str], mode: str) -> Column:
    if mode == "finite":
        return _complete(features)
    if mode == "trading":
        return F.coalesce(F.col("is_trading_day").cast("boolean"), F.lit(False))
    raise ValueError(f"unknown mode {mode!r}")


def lookback_windows(
    panel: DataFrame,
    lookback: int,
    features: list[str],
    targets: list[str],
    masks: list[str],
    mode: str = "finite",
    require_all: bool = True,
    span_rows: int | None = None,
) -> DataFrame:
    """``(symbol, label_date, x, m, asset_id, y)`` for each accepted label row t.

    ``x`` holds the features of rows t-lookback .. t-1, ``m`` their validity (all features
    finite, or trading day), ``asset_id`` that of row t-1. Arrays have ``lookback`` entries,
    whatever the length of the history. With ``span_rows`` a symbol's history is dealt out in ranges of so
    many rows: one more exchange, for histories that are too long for a task.
    """
    marked = valid_labels(panel, lookback, _step_ok(features, mode), targets, masks, require_all)
    y = F.array(*[F.col(c).cast("float") for c in targets])
    if span_rows is not None:
        cut, inside = _cut_ranges(marked, lookback, span_rows, _row(features), F.col("asset_id"), y, "_ok")
        made = {"x": F.collect_list("_x"), "m": F.collect_list("_ok")}
        cut = cut.withColumns({n: c.over(_before(lookback, inside)) for n, c in made.items()} | {"_id": F.lag("asset_id", 1).over(inside)})
        return cut.where("_valid").select(SYMBOL, "label_date", "x", "m", F.col("_id").alias("asset_id"), "y")
    rows = marked.withColumns(
        {
            "x": F.collect_list(_row(features)).over(_before(lookback)),
            "m": F.collect_list("_ok").over(_before(lookback)),
            "_id": F.lag("asset_id", 1).over(by_symbol()),
        }
    )
    return rows.where("_valid").select(SYMBOL, F.col(DATE).alias("label_date"), "x", "m", F.col("_id").alias("asset_id"), y.alias("y"))


def _cut_ranges(marked: DataFrame, lookback: int, span_rows: int, row: Column, asset: Column, y: Column, *more: str) -> tuple[DataFrame, WindowSpec]:
    """``symbol, label_date, _valid, asset_id, y, _x`` and ``more`` of all rows in ranges, and the order inside a range.

    A symbol's history is cut into ranges of rows that also get the last ``lookback`` rows of the range before, which
    are no labels there. Ranges are dealt out by (symbol, range), so a long history is many tasks, whose rows
    are windowed as they come and never gathered.
    """
    span = max(span_rows, lookback)
    numbered = marked.withColumn("_at", (F.row_number().over(by_symbol()) - 1).cast("long"))
    of = F.expr(f"_at div {span}")
    halo = F.col("_at") % span >= span - lookback
    step = [F.col("_at"), F.col("_valid"), F.col(DATE).alias("label_date"), row.alias("_x"), asset.alias("asset_id"), y.alias("y"), *more]
    copies = numbered.select(SYMBOL, F.explode(F.when(halo, F.array(of, of + 1)).otherwise(F.array(of))).alias("_range"), *step)
    dealt = copies.withColumn("_valid", F.col("_valid") & (of == F.col("_range"))).repartition(SYMBOL, "_range")
    return dealt, Window.partitionBy(SYMBOL, "_range").orderBy("_at")


def count_samples(
    panel: DataFrame, lookback: int, features: list[str], targets: list[str], masks: list[str],
    mode: str = "finite", require_all: bool = True,
) -> DataFrame:
    """Accepted windows per symbol, without building any."""
    marked = valid_labels(panel, lookback, _step_ok(features, mode), targets, masks, require_all)
    return marked.groupBy(SYMBOL).agg(F.count_if("_valid").alias("n_samples"))


def scan_panel(
    panel: DataFrame, start: str, end: str, lookback: int, hmax: int, symbols: DataFrame | None = None
) -> DataFrame:
    """Rows needed to label [start, end]: both bounds become scan filters on date."""
    lo = F.date_sub(F.lit(start).cast("date"), lookback + 5)
    hi = F.date_add(F.lit(end).cast("date"), hmax)
    rows = panel.where(F.col(DATE).between(lo, hi))
    if symbols is None:
        return rows
    return rows.join(size_checked(symbols.select(SYMBOL).distinct()), SYMBOL, "left_semi")


def label_rows(
    panel: DataFrame, lookback: int, features: list[str], horizons: list[int], start: str, end: str
) -> DataFrame:
    """Fetched rows up to ``end`` with filled features, targets ``y`` and the ``_valid`` flag.

    A label needs ``lookback`` rows before it, the longest horizon after it (both inside the
    fetched range), its date in [start, end] and usable prices at itself and every horizon.
    """
    hmax = max(horizons)
    fetched = scan_panel(panel, start, end, lookback, hmax)
    fetched = ensure_columns(fetched, features)
    fetched = fetched.withColumns({c: finite_or_null(F.col(c).cast("float")) for c in features})
    filled = fill_gaps(fetched, features)
    # a close that is itself a feature labels with its filled value
    log_price = F.ln(positive_or_null(F.col("close").cast("double")))
    changes = [(F.lead(log_price, h).over(by_symbol()) - log_price).cast("float") for h in horizons]
    labelled = filled.withColumns(
        {
            "y": F.array(*changes),
            "_rn": F.row_number().over(by_symbol()),
            "_n": F.count("*").over(whole()),
        }
    )
    day = F.col(DATE)
    inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    feasible = (F.col("_rn") > lookback) & (F.col("_rn") <= F.col("_n") - hmax)
    usable = ~F.exists("y", lambda v: v.isNull())
    # rows after the last label were only needed for the targets
    return labelled.where(day <= F.lit(end).cast("date")).withColumn("_valid", inside & feasible & usable)


def label_range_windows(
    panel: DataFrame, lookback: int, features: list[str], horizons: list[int], start: str, end: str, span_rows: int | None = None
) -> DataFrame:
    """``(symbol, label_date, x, m, asset_id, y)`` for labels in [start, end]; ``span_rows`` as in ``lookback_windows``."""
    rows = label_rows(panel, lookback, features, horizons, start, end)
    asset = F.coalesce(F.col("asset_id") if "asset_id" in panel.columns else F.lit(0), F.lit(0))
    if span_rows is not None:
        cut, inside = _cut_ranges(rows, lookback, span_rows, _row(features), asset, F.col("y"))
        cut = cut.withColumn("x", F.collect_list("_x").over(_before(lookback, inside)))
        return cut.where("_valid").select(SYMBOL, "label_date", "x", F.array_repeat(F.lit(True), lookback).alias("m"), "asset_id", "y")
    rows = rows.withColumn("x", F.collect_list(_row(features)).over(_before(lookback)))
    return rows.where("_valid").select(SYMBOL, F.col(DATE).alias("label_date"), "x", F.array_repeat(F.lit(True), lookback).alias("m"), asset.alias("asset_id"), "y")


def inference_window(
    panel: DataFrame, as_of: str, lookback: int, features: list[str], allow_fallback: bool = True
) -> DataFrame:
    """The window before each symbol's as-of row, without any future data.

    The as-of row is the symbol's row on ``as_of`` or, when allowed, its latest earlier one in
    the fetched range. A short history is padded on the left with its first row (mask false);
    a symbol whose as-of row has no row before it, or no usable close, yields nothing.
    """
    day = F.lit(as_of).cast("date")
    rows = ensure_columns(scan_panel(panel, as_of, as_of, lookback, 0), features)
    rows = rows.withColumns({c: finite_or_null(F.col(c).cast("float")) for c in features})
    rows = fill_gaps(rows, features).withColumns(
        {
            "_price": positive_or_null(F.col("close").cast("double")),
            "_rn": F.row_number().over(by_symbol()),
            "_n": F.count("*").over(whole()),
        }
    )
    # the label row itself and the lookback rows before it
    recent = rows.where(F.col("_rn") >= F.col("_n") - lookback)
    step = F.struct(F.col(DATE).alias("d"), _row(features).alias("v"))
    is_label = F.col("_rn") == F.col("_n")
    asset = F.col("asset_id") if "asset_id" in panel.columns else F.lit(0)
    grouped = recent.groupBy(SYMBOL).agg(
        F.max(DATE).alias("label_date"),
        F.sort_array(F.collect_list(F.when(~is_label, step))).alias("_steps"),
        F.max(F.when(is_label, F.col("_price"))).alias("_price"),
        F.max(F.when(is_label, F.coalesce(asset, F.lit(0)))).alias("asset_id"),
    )
    kept = grouped.where((F.size("_steps") > 0) & F.col("_price").isNotNull())
    if not allow_fallback:
        kept = kept.where(F.col("label_date") == day)
    values = F.transform("_steps", lambda s: s["v"])
    pad = F.lit(lookback) - F.size("_steps")
    return kept.select(
        SYMBOL,
        "label_date",
        F.concat(F.array_repeat(F.get(values, 0), pad), values).alias("x"),
        F.concat(F.array_repeat(F.lit(False), pad), F.transform("_steps", lambda s: F.lit(True))).alias("m"),
        "asset_id",
    )


def last_window(panel: DataFrame, lookback: int, features: list[str]) -> DataFrame:
    """The last ``lookback`` rows of each symbol, the latest included; shorter ones are left out."""
    newest = Window.partitionBy(SYMBOL).orderBy(F.col(DATE).desc())
    recent = panel.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= lookback)
    trading = F.col("is_trading_day").cast("boolean") if "is_trading_day" in panel.columns else F.lit(True)
    asset = F.col("asset_id") if "asset_id" in panel.columns else F.lit(0)
    step = F.struct(F.col(DATE).alias("d"), _row(features).alias("v"), trading.alias("t"))
    grouped = recent.groupBy(SYMBOL).agg(
        F.max(DATE).alias("label_date"),
        F.sort_array(F.collect_list(step)).alias("_steps"),
        F.max(F.when(F.col("_back") == 1, asset)).alias("asset_id"),
    )
    return grouped.where(F.size("_steps") == lookback).select(
        SYMBOL,
        "label_date",
        F.transform("_steps", lambda s: s["v"]).alias("x"),
        F.transform("_steps", lambda s: s["t"]).alias("m"),
        "asset_id",
    )
