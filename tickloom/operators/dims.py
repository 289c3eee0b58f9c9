"""Daily context tables: exchange rates, news and weather, one row per date."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.arrays import clean_list, finite_mean, pad_list
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.scalars import finite_or_null, floor_day, is_finite, safe_log
from tickloom.operators.clean import prefix_columns
from tickloom.operators.moments import Products, daily_products, pivots, range_totals, running
from tickloom.schemas import DATE, WEATHER_COLS


# --- exchange rates ---------------------------------------------------------------------


def fx_log_return(fx: DataFrame, base: str = "base_currency") -> DataFrame:
    """Mean daily log return over all currencies of a wide rate table: ``(date, eur_fx_logret)``.

    A missing rate repeats the last one, so its return is 0 but it still counts in the mean;
    leading gaps take the first rate. The table is turned long, so 170 currencies cost one
    window instead of 170. Several quotes of a day are averaged beforehand (with partials), so
    a (base, currency) series is never longer than the calendar.
    """
    days = fx.withColumn(DATE, floor_day(DATE)).dropna(subset=[DATE])
    has_base = base in fx.columns
    rates = [c for c in fx.columns if c not in (DATE, base)]
    if not rates:
        return days.select(DATE).distinct().withColumn("eur_fx_logret", F.lit(0.0).cast("float"))
    keys = [DATE, base] if has_base else [DATE]
    quotes = {c: F.avg(finite_or_null(F.col(c).try_cast("double"))).alias(c) for c in rates}
    wide = days.groupBy(*keys).agg(*quotes.values())
    long = wide.unpivot(keys, rates, "ccy", "rate")
    series = [base, "ccy"] if has_base else ["ccy"]
    before = Window.partitionBy(*series).orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    step = safe_log("rate") - safe_log(F.last("rate", ignorenulls=True).over(before))
    moved = long.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return moved.groupBy(DATE).agg(F.avg("_step").cast("float").alias("eur_fx_logret"))


# --- weather ----------------------------------------------------------------------------


def weather_daily(weather: DataFrame, agg: str = "mean") -> DataFrame:
    """Mean or exact median of each measure per date over all stations, as ``wx_*``."""
    cols = [c for c in WEATHER_COLS if c in weather.columns]
    days = weather.select(
        floor_day(DATE).alias(DATE), *[finite_or_null(F.col(c).try_cast("float")).alias(c) for c in cols]
    ).dropna(subset=[DATE])
    if agg == "mean":
        return prefix_columns(days.groupBy(DATE).agg(*[F.avg(c).alias(c) for c in cols]), "wx_")
    if agg != "median":
        raise ValueError(f"unknown aggregate {agg!r}")
    middle = exact_quantiles(days, [DATE], cols, [0.5])
    # dates without any present value stay, with missing medians
    wide = middle.groupBy(DATE).pivot("measure", cols).agg(F.first("value"))
    return prefix_columns(days.select(DATE).distinct().join(wide, DATE, "left"), "wx_")


# --- news -------------------------------------------------------------------------------


def news_sentiment_scalar(news: DataFrame) -> DataFrame:
    col = finite_mean("sentiment") if "sentiment" in news.columns else F.lit(0.0)
    return news.withColumn("sentiment_scalar", col)


def news_daily(news: DataFrame) -> DataFrame:
    """Mean and largest sentiment, headline count and mean of each ``news_pca_*`` per date."""
    scored = news if "sentiment_scalar" in news.columns else news_sentiment_scalar(news)
    pcs = [c for c in news.columns if c.startswith("news_pca_")]
    days = scored.withColumn(DATE, floor_day(DATE)).dropna(subset=[DATE])
    return days.groupBy(DATE).agg(
        F.avg("sentiment_scalar").cast("float").alias("news_sent_mean"),
        F.max("sentiment_scalar").cast("float").alias("news_sent_max"),
        F.count("sentiment_scalar").alias("news_count"),
        *[F.avg(c).cast("float").alias(c) for c in pcs],
    )


# --- principal components ---------------------------------------------------------------


@dataclass(frozen=True)
class PcaFit:
    """Centre, scale and loadings of a fitted rotation; a few numbers per column."""

    cols: list[str]
    mean: list[float]
    std: list[float]
    loadings: list[list[float]]  # one list per component
    names: list[str]


def _signed(pc: np.ndarray) -> np.ndarray:
    """Each component turned so that its largest loading is positive."""
    top = np.abs(pc).argmax(axis=0)
    flip = np.sign(pc[top, np.arange(pc.shape[1])])
    return pc * np.where(flip == 0, 1.0, flip)


def restrict_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows whose date occurs in ``dates``."""
    return df.join(dates.select(DATE).distinct(), DATE, "left_semi")


def fit_pca(daily: DataFrame, k: int, fit_dates: DataFrame | None = None) -> PcaFit | None:
    """Population-standardise the ``wx_*`` columns (missing is 0) and fit min(k, columns)
    components, on the given dates only when ``fit_dates`` is passed."""
    cols = [c for c in daily.columns if c.startswith("wx_")]
    rows = restrict_dates(daily, fit_dates) if fit_dates is not None else daily
    if not cols:
        return None
    rows = rows.fillna(0.0, cols)
    stats = rows.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
    ).first()
    if not stats["n"]:
        return None
    mean = [stats[f"m_{i}"] for i in range(len(cols))]
    std = [stats[f"s_{i}"] or 1.0 for i in range(len(cols))]
    z = F.array(*[(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, mean, std)])
    model = PCA(k=min(k, len(cols)), inputCol="z", outputCol="pc").fit(rows.select(array_to_vector(z).alias("z")))
    pc = _signed(model.pc.toArray())
    return PcaFit(cols, mean, std, pc.T.tolist(), [f"wx_pca_{i}" for i in range(pc.shape[1])])


def fold_pca(daily: DataFrame, k: int, ranges: DataFrame, start: str = "tr_start", end: str = "tr_end") -> dict[int, PcaFit]:
    """``fit_pca`` on the dates of every range, by fold, from one pass over ``daily``.

    The products of the columns are kept per date and differenced per range, so no fold reads rows again; the
    eigenvectors of a range's correlations are found on the driver, from as many numbers as there are pairs of columns.
    """
    cols = [c for c in daily.columns if c.startswith("wx_")]
    if not cols:
        return {}
    filled = daily.fillna(0.0, cols)
    at = pivots(filled, cols)
    totals = running(daily_products(filled, [F.col(c) - F.lit(p) for c, p in zip(cols, at)]))
    fits = {}
    for row in range_totals(totals, ranges, start, end).where("n > 0").collect():  # one row per fold
        moments = Products.of(row, len(cols), at)
        std = np.where(moments.std() > 0, moments.std(), 1.0)
        values, vectors = np.linalg.eigh(moments.centred / moments.n / np.outer(std, std))
        order = np.argsort(values, kind="stable")[::-1][: min(k, len(cols))]
        pc = _signed(vectors[:, order])
        fits[row["fold"]] = PcaFit(cols, moments.mean.tolist(), std.tolist(), pc.T.tolist(), [f"wx_pca_{i}" for i in range(len(order))])
    return fits


def transform_pca(daily: DataFrame, fit: PcaFit | None, names: list[str] = []) -> DataFrame:
    """Project every date; without a fit the named components are zero."""
    if fit is None:
        return daily.select(DATE, *[F.lit(0.0).alias(n) for n in names])
    z = [(F.coalesce(F.col(c), F.lit(0.0)) - F.lit(m)) / F.lit(s) for c, m, s in zip(fit.cols, fit.mean, fit.std)]
    comps = []
    for name, weights in zip(fit.names, fit.loadings):
        terms = [x * F.lit(w) for x, w in zip(z, weights)]
        comps.append(sum(terms[1:], terms[0]).alias(name))
    return daily.select(DATE, *comps)


def news_embedding_pca(news: DataFrame, components: int | None = None) -> DataFrame:
    """Zero-pad embeddings to the longest, rotate them onto centred principal components and add
    the first ``components`` (default: all) of these as ``news_pca_*``."""
    if "embeddings" not in news.columns:
        return news
    usable = F.exists("embeddings", lambda e: is_finite(e))
    vec = F.when(F.coalesce(usable, F.lit(False)), clean_list("embeddings")).otherwise(F.array().cast("array<float>"))
    listed = news.withColumn("_emb", vec)
    dim = listed.agg(F.max(F.size("_emb"))).first()[0] or 0
    if dim == 0:
        return news
    padded = listed.withColumn("_emb", pad_list("_emb", dim))
    centre = padded.agg(*[F.avg(F.element_at("_emb", i + 1)).alias(str(i)) for i in range(dim)]).first()
    mean = F.array(*[F.lit(float(centre[i])) for i in range(dim)])
    centred = padded.withColumn("_z", array_to_vector(F.zip_with("_emb", mean, lambda x, m: x.cast("double") - m)))
    kept = min(components or dim, dim)
    model = PCA(k=kept, inputCol="_z", outputCol="_pc").fit(centred.select("_z"))
    raw = model.pc.toArray()
    # the model's own projection, with the sign rule applied per component
    flips = [float(f) for f in np.where((_signed(raw) * raw).sum(axis=0) < 0, -1.0, 1.0)]
    arr = vector_to_array("_pc")
    out = model.transform(centred).withColumn("_arr", arr)
    comps = {f"news_pca_{i}": F.element_at("_arr", i + 1) * F.lit(flips[i]) for i in range(kept)}
    return out.withColumns(comps).drop("_emb", "_z", "_pc", "_arr")
