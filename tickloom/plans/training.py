"""Fitting per-horizon forecasters on summaries of lookback windows with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.quantiles import exact_quantiles
from tickloom.operators.aggregates import smooth_l1
from tickloom.operators.calendar import by_symbol
from tickloom.operators.dims import fold_pca, restrict_dates
from tickloom.operators.clean import feature_roles
from tickloom.operators.joins import assign_folds, join_weather
from tickloom.operators.moments import Products, daily_products, pivots, range_totals, running
from tickloom.operators.scaler import NoTrainingRows, fit_window_scaler, scaler_values
from tickloom.operators.splits import date_range, walk_forward_ranges
from tickloom.operators.unions import union_folds
from tickloom.operators.windows import label_rows
from tickloom.plans.features import TASK_ROWS
from tickloom.plans.pinball import fit_pinball
from tickloom.schemas import DATE, SYMBOL
from tickloom.session import staged


@dataclass
class Forecaster:
    """A regression per horizon over the window summary, plus what scoring needs."""

    features: list[str]
    horizons: list[int]
    lookback: int
    scaler: dict[str, tuple[float, float]]
    models: list = field(default_factory=list)
    residual_quantiles: dict[tuple[int, float], float] = field(default_factory=dict)
    chosen: list[str] | None = None
    #: Coefficients (intercept first) per horizon instead of ``models``, and per horizon and quantile.
    linear: list[list[float]] | None = None
    quantile_models: dict[tuple[int, float], list[float]] = field(default_factory=dict)

    def inputs(self) -> list[str]:
        return self.chosen or [f"{kind}_{c}" for c in self.features for kind in ("last", "mean")]

    def predict(self, summary: DataFrame) -> DataFrame:
        """``summary`` with one column ``pred_<i>`` per horizon position."""
        if self.linear is not None:
            return summary.withColumns({f"pred_{i}": linear_forecast(self.inputs(), c) for i, c in enumerate(self.linear)})
        out = VectorAssembler(inputCols=self.inputs(), outputCol="_vec").transform(summary)
        for i, model in enumerate(self.models):
            out = model.copy().setPredictionCol(f"pred_{i}").transform(out)
        return out.drop("_vec")

    def predict_quantiles(self, summary: DataFrame, quantiles: list[float]) -> DataFrame:
        """``predict`` with a column ``pred_<i>_p<q>`` per horizon position and quantile.

        Quantiles fitted on the pinball loss are put in order per row, so they never cross; the others are the
        point forecast plus the residual quantile.
        """
        out = self.predict(summary)
        for i, h in enumerate(self.horizons):
            ascending = sorted(quantiles)
            if all((h, q) in self.quantile_models for q in ascending):
                values = F.array_sort(F.array(*[linear_forecast(self.inputs(), self.quantile_models[(h, q)]) for q in ascending]))
                columns = [F.element_at(values, n + 1) for n in range(len(ascending))]
            else:
                columns = [F.col(f"pred_{i}") + F.lit(self.residual_quantiles[(h, q)]) for q in ascending]
            out = out.withColumns({f"pred_{i}_p{round(q * 100)}": c for q, c in zip(ascending, columns)})
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Models, scaler, roles and residual quantiles below ``path``; replaces what is there.

        The description is written last, so a half-written folder cannot be loaded.
        """
        for h, model in zip(self.horizons, self.models):
            model.write().overwrite().save(f"{path}/horizon={h}")
        told = {
            "features": self.features, "horizons": self.horizons, "lookback": self.lookback, "scaler": self.scaler, "chosen": self.chosen,
            "roles": feature_roles(self.features), "residual_quantiles": [[h, q, v] for (h, q), v in self.residual_quantiles.items()],
            "linear": self.linear, "quantile_models": [[h, q, v] for (h, q), v in self.quantile_models.items()],
        }
        spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{path}/description")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecaster:
        told = json.loads(spark.read.schema("told string").parquet(f"{path}/description").first()["told"])
        linear = told.get("linear")
        models = [LinearRegressionModel.load(f"{path}/horizon={h}") for h in told["horizons"]] if linear is None else []
        scaler = {c: tuple(v) for c, v in told["scaler"].items()}
        quantiles = {(h, q): v for h, q, v in told["residual_quantiles"]}
        fitted = {(h, q): v for h, q, v in told.get("quantile_models", [])}
        return cls(told["features"], told["horizons"], told["lookback"], scaler, models, quantiles, told["chosen"], linear, fitted)


def linear_forecast(inputs: list[str], coefficients: list[float]) -> Column:
    """Intercept plus weighted inputs."""
    return sum((F.col(c) * F.lit(float(w)) for c, w in zip(inputs, coefficients[1:])), F.lit(float(coefficients[0])))


def _scaled(col, values: tuple[float, float]):
    mean, std = values
    return (col - F.lit(mean)) / F.lit(max(std, 1e-12))


def summarise_rows(rows: DataFrame, lookback: int, features: list[str], scaler: dict) -> DataFrame:
    """Last value and mean of each scaled feature over the window before every row.

    Equal to summarising the window arrays, without building them.
    """
    before = by_symbol().rowsBetween(-lookback, -1)
    cols = {}
    for c in features:
        value = F.col(c).cast("double")
        cols[f"last_{c}"] = _scaled(F.lag(value, 1).over(by_symbol()), scaler[c])
        cols[f"mean_{c}"] = _scaled(F.avg(value).over(before), scaler[c])
    return rows.withColumns(cols)


def summarise_windows(windows: DataFrame, features: list[str], scaler: dict) -> DataFrame:
    """The same summary from window arrays ``x``."""
    def at(row, i: int):
        return F.get(row, i).cast("double")

    def added(i: int):
        return lambda acc, row: acc + at(row, i)

    cols = {}
    for i, c in enumerate(features):
        total = F.aggregate("x", F.lit(0.0), added(i))
        cols[f"last_{c}"] = _scaled(at(F.try_element_at("x", F.lit(-1)), i), scaler[c])
        cols[f"mean_{c}"] = _scaled(total / F.size("x"), scaler[c])
    return windows.withColumns(cols)


def fit_columns(panel: DataFrame, features: list[str]) -> DataFrame:
    """What fits and forecasts read of a panel, so that nothing else is computed for them or stored."""
    return panel.select(*[c for c in dict.fromkeys([SYMBOL, DATE, "close", *features]) if c in panel.columns])


def dealt(panel: DataFrame) -> DataFrame:
    """A stored panel dealt out by symbol in tasks of about ``TASK_ROWS`` rows: its bytes, most of them repeats, do not tell."""
    return panel.repartition(-(-panel.count() // TASK_ROWS) or 1, SYMBOL)


def training_rows(
    panel: DataFrame, lookback: int, features: list[str], horizons: list[int], start, end, scaler: dict | None = None
) -> tuple[DataFrame, dict]:
    """Accepted labels in [start, end] with their summaries and ``y``; fits the scaler if none is given."""
    marked = label_rows(dealt(panel), lookback, features, horizons, str(start), str(end))
    if scaler is None:
        marked = staged(marked.select(SYMBOL, DATE, *features, "y", "_valid"), "labels")  # read by the scaler and by the fit
        scaler = scaler_values(fit_window_scaler(marked, features, lookback))
    rows = summarise_rows(marked, lookback, features, scaler).where("_valid")
    keep = [c for f in features for c in (f"last_{f}", f"mean_{f}")]
    return rows.select(SYMBOL, F.col(DATE).alias("label_date"), "y", *keep), scaler


def fit_point(
    train: DataFrame,
    features: list[str],
    horizons: list[int],
    lookback: int,
    scaler: dict,
    loss: str = "huber",
    max_iter: int = 50,
    inputs: list[str] | None = None,
) -> Forecaster:
    """One linear forecaster per horizon. The default loss grows linearly for large errors."""
    fc = Forecaster(features, horizons, lookback, scaler, chosen=inputs)
    vec = VectorAssembler(inputCols=fc.inputs(), outputCol="_vec").transform(train)
    labels = [F.element_at("y", i + 1).cast("double").alias(f"_y{i}") for i in range(len(horizons))]
    data = staged(vec.select("_vec", *labels), "fit")
    for i in range(len(horizons)):
        lr = LinearRegression(featuresCol="_vec", labelCol=f"_y{i}", loss=loss, maxIter=max_iter)
        fc.models.append(lr.fit(data))
    return fc


def residuals(fc: Forecaster, rows: DataFrame) -> DataFrame:
    """``(symbol, label_date, horizon, actual, predicted, residual)``, one row per horizon."""
    scored = fc.predict(rows)
    items = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.element_at("y", i + 1).cast("double").alias("actual"),
                F.col(f"pred_{i}").alias("predicted"),
            )
            for i, h in enumerate(fc.horizons)
        ]
    )
    long = scored.select(SYMBOL, "label_date", F.explode(items).alias("r")).select(SYMBOL, "label_date", "r.*")
    return long.withColumn("residual", F.col("actual") - F.col("predicted"))


def fit_quantile(fc: Forecaster, train: DataFrame, quantiles: list[float], method: str = "residual") -> Forecaster:
    """Adds quantiles per horizon: exact residual quantiles, found without gathering the residuals, or, with
    ``method="pinball"``, a forecaster of its own for every quantile that minimises the pinball loss."""
    if method == "pinball":
        fc.quantile_models |= fit_pinball(train, fc.inputs(), fc.horizons, quantiles)
        return fc
    if method != "residual":
        raise ValueError(f"unknown method {method!r}")
    # read several times: stored narrow rather than recomputed from the windows
    stored = staged(residuals(fc, train).select("horizon", "residual"), "residuals")
    table = exact_quantiles(stored, ["horizon"], ["residual"], quantiles, few=True)
    fc.residual_quantiles = {(r["horizon"], r["prob"]): r["value"] for r in table.collect()}
    return fc


def validation_loss(fc: Forecaster, rows: DataFrame) -> tuple[float | None, int]:
    """Mean loss over all labels and horizons, and the number of labels."""
    r = residuals(fc, rows).agg(F.avg(smooth_l1(F.col("residual"))).alias("loss"), F.count("*").alias("n")).first()
    return r["loss"], r["n"] // len(fc.horizons)


def _folds(
    panel: DataFrame, features: list[str], horizons: list[int], lookback: int, train: int, val: int, step: int,
    hmax: int | None, weather_daily: DataFrame | None, weather_components: int, fit: Callable[..., Forecaster],
) -> Iterator[tuple[Row, Forecaster, DataFrame]]:
    """``(ranges, fitted model, validation rows)`` of every fold with training labels.

    The panel is stored once in the shared folder, laid out by date: files and row groups outside a
    fold's dates are skipped by their statistics.
    """
    stored = staged(fit_columns(panel, features).repartitionByRange(DATE).sortWithinPartitions(DATE, SYMBOL), "panel")
    ranges = walk_forward_ranges(date_range(stored), train, val, step, max(horizons) if hmax is None else hmax)
    reach = max(horizons)
    components = {}
    if weather_daily is not None:
        known = restrict_dates(weather_daily, stored.select(DATE))
        components = fold_pca(known, weather_components, ranges)
    for f in ranges.orderBy("fold").collect():  # one row per fold
        # windows look back, targets look ahead; rows further away cannot matter to this fold
        near = F.col(DATE).between(F.date_sub(F.lit(f["tr_start"]), lookback + 1), F.date_add(F.lit(f["va_end"]), reach + 1))
        rows, used = stored.where(near), list(features)
        if f["fold"] in components:
            rows = join_weather(rows, weather_daily, weather_components, fit=components.get(f["fold"]))
            used += [c for c in rows.columns if c.startswith("wx_pca_")]
        try:
            tr, scaler = training_rows(rows, lookback, used, horizons, f["tr_start"], f["tr_end"])
        except NoTrainingRows:
            continue
        fc = fit(tr, used, horizons, lookback, scaler)
        yield f, fc, training_rows(rows, lookback, used, horizons, f["va_start"], f["va_end"], scaler)[0]


def walk_forward_evaluate(
    panel: DataFrame,
    features: list[str],
    horizons: list[int],
    lookback: int,
    train: int,
    val: int,
    step: int,
    hmax: int | None = None,
    weather_daily: DataFrame | None = None,
    weather_components: int = 12,
    fit: Callable[..., Forecaster] = fit_point,
) -> tuple[DataFrame, Forecaster | None]:
    """Per fold: scale on train, fit, measure on val. Returns the metrics and the last fitted model.

    With ``weather_daily`` the components are refitted on each fold's training dates. Folds
    without training labels are skipped.
    """
    metrics, last = [], None
    for f, last, va in _folds(panel, features, horizons, lookback, train, val, step, hmax, weather_daily, weather_components, fit):
        loss, n = validation_loss(last, va)
        metrics.append((f["fold"], f["tr_start"], f["tr_end"], f["va_start"], f["va_end"], n, loss))
    schema = "fold int, tr_start date, tr_end date, va_start date, va_end date, n_val long, val_loss double"
    return panel.sparkSession.createDataFrame(metrics, schema), last


def walk_forward_predictions(
    panel: DataFrame,
    features: list[str],
    horizons: list[int],
    lookback: int,
    train: int,
    val: int,
    step: int,
    hmax: int | None = None,
    quantiles: list[float] = [],
    fit: Callable[..., Forecaster] = fit_point,
) -> DataFrame:
    """Validation forecasts of all folds: fold (1-based), symbol, label_date, horizon, actual, predicted, residual
    and, for every quantile, ``p<q>``: the forecast plus the training residuals' quantile."""
    parts = []

    def fitted(tr: DataFrame, *args) -> Forecaster:
        fc = fit(tr, *args)
        return fit_quantile(fc, tr, quantiles) if quantiles else fc

    for _, fc, va in _folds(panel, features, horizons, lookback, train, val, step, hmax, None, 0, fitted):
        out = residuals(fc, va)
        for q in quantiles:
            shift = F.create_map(*[F.lit(x) for h in horizons for x in (h, fc.residual_quantiles[(h, q)])])
            out = out.withColumn(f"p{round(q * 100)}", F.col("predicted") + F.element_at(shift, F.col("horizon")))
        parts.append(staged(out, "fold"))
    if not parts:
        raise NoTrainingRows("no fold has training labels")
    return union_folds(parts)


def fold_fits(rows: DataFrame, inputs: list[str], horizons: list[int], ranges: DataFrame) -> dict[tuple[int, int], list[float]]:
    """Least-squares coefficients (intercept first) per fold and horizon, from one pass over ``rows``.

    ``rows`` are the training rows of all folds (``label_date``, the inputs and ``y``). Their products are kept per
    date and differenced per fold, so no fold reads rows again.
    """
    values = [F.col(c).cast("double") for c in inputs] + [F.element_at("y", i + 1).cast("double") for i in range(len(horizons))]
    named = rows.select("label_date", *[v.alias(f"_c{i}") for i, v in enumerate(values)])
    cols = [f"_c{i}" for i in range(len(values))]
    at = pivots(named, cols)
    totals = running(daily_products(named, [F.col(c) - F.lit(a) for c, a in zip(cols, at)], "label_date"))
    fits = {}
    for row in range_totals(totals, ranges, "tr_start", "tr_end").where("n > 0").collect():  # one row per fold
        moments = Products.of(row, len(cols), at)
        for i, h in enumerate(horizons):
            intercept, slopes = moments.least_squares(list(range(len(inputs))), len(inputs) + i)
            fits[(row["fold"], h)] = [intercept, *map(float, slopes)]
    return fits


def walk_forward_linear(
    panel: DataFrame, features: list[str], horizons: list[int], lookback: int, train: int, val: int, step: int,
    hmax: int | None = None, inputs: list[str] | None = None,
) -> DataFrame:
    """``walk_forward_predictions`` of least-squares forecasters without a pass per fold.

    All folds are fitted from one table of daily products, and all validation rows are scored together: each is
    joined to the folds of its date and to their coefficients. For panels without gaps between a symbol's dates.
    """
    stored = staged(fit_columns(panel, features), "panel")
    bounds = date_range(stored).first()
    unit = {c: (0.0, 1.0) for c in features}
    if bounds["lo"] is None:
        raise NoTrainingRows("the panel is empty")
    rows = staged(training_rows(stored, lookback, features, horizons, bounds["lo"], bounds["hi"], unit)[0], "labels")
    used = inputs or [f"{kind}_{c}" for c in features for kind in ("last", "mean")]
    ranges = staged(walk_forward_ranges(date_range(stored), train, val, step, max(horizons) if hmax is None else hmax), "folds")
    fits = fold_fits(rows, used, horizons, ranges)
    if not fits:
        raise NoTrainingRows("no fold has training labels")
    # numbered from 1 in the order of the folds that have labels; a few rows per fold
    place = {f: i + 1 for i, f in enumerate(sorted({f for f, _ in fits}))}
    table = panel.sparkSession.createDataFrame([(f, place[f], h, c) for (f, h), c in fits.items()], "raw int, fold int, horizon int, _c array<double>")
    roles = ranges.select("fold", F.lit("val").alias("role"), F.col("va_start").alias("start"), F.col("va_end").alias("end"))
    scored = assign_folds(rows, roles, "label_date").withColumnRenamed("fold", "raw").join(F.broadcast(table), "raw")
    value = sum((F.col(c) * F.element_at("_c", i + 2) for i, c in enumerate(used)), F.element_at("_c", 1))
    actual = F.element_at("y", F.array_position(F.array(*[F.lit(h) for h in horizons]), F.col("horizon")).cast("int")).cast("double")
    out = scored.select("fold", SYMBOL, "label_date", "horizon", actual.alias("actual"), value.alias("predicted"))
    return out.withColumn("residual", F.col("actual") - F.col("predicted"))
