"""The jobs around a stored panel: train a forecaster and keep it, score with a kept one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.scoring import forecaster_scorer, quantile_scorer, score_as_of
from tickloom.plans.training import Forecaster, fit_point, fit_quantile, training_rows
from tickloom.schemas import SYMBOL
from tickloom.session import staged
from tickloom.sources.ingest import read_required, stored_bounds
from tickloom.sources.sinks import write_predictions_csv


def train(
    spark: SparkSession,
    panel: str,
    model: str,
    features: list[str],
    horizons: list[int],
    lookback: int,
    start: str | None = None,
    end: str | None = None,
    quantiles: list[float] = [],
    quantile_method: str = "residual",
    **fit_options,
) -> Forecaster:
    """Fits on the labels of the stored ``panel`` within [start, end] (default: all) and saves to ``model``."""
    table = read_required(spark, panel)
    first, last, _ = (start, end, 0) if start and end else stored_bounds(spark, panel)
    rows, scaler = training_rows(table, lookback, features, horizons, start or first, end or last)
    if quantiles:
        # read by both fits
        inputs = fit_options.get("inputs") or [c for c in rows.columns if c not in (SYMBOL, "label_date", "y")]
        rows = staged(rows.select(SYMBOL, "label_date", "y", *inputs), "labels")
    fc = fit_point(rows, features, horizons, lookback, scaler, **fit_options)
    if quantiles:
        fit_quantile(fc, rows, quantiles, quantile_method)
    fc.save(spark, model)
    return fc


def predict(
    spark: SparkSession,
    model: str,
    panel: str,
    as_of: str,
    k: int = 25,
    price_col: str = "open",
    csv: str | None = None,
    table: str | None = None,
    quantile: float | None = None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best symbols of the stored ``panel`` on ``as_of`` by the kept ``model``, as the prediction table.

    With ``quantile``, forecasts and ranking are that quantile's instead of the point forecast's; ``symbols``
    restricts the panel to those listed.
    ``csv`` and ``table`` (a Parquet folder that is appended to) name where it is written, if anywhere.
    """
    fc = Forecaster.load(spark, model)
    scorer = forecaster_scorer(fc) if quantile is None else quantile_scorer(fc, quantile)
    out = score_as_of(read_required(spark, panel), scorer, fc.features, fc.horizons, as_of, fc.lookback, k, price_col=price_col, symbols=symbols)
    if csv is not None:
        write_predictions_csv(out, csv)
    if table is not None:
        out.write.mode("append").parquet(table)
    return out


__all__ = ["predict", "train"]
