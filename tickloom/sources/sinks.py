"""Prediction sinks and the tables a fitted model is stored with."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.rank import top_k
from tickloom.schemas import SYMBOL, scaler_schema

log = logging.getLogger(__name__)


def write_predictions_csv(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").option("header", True).csv(path)


def topk_rows(predictions: DataFrame, score: str, k: int, as_of: str) -> DataFrame:
    return top_k(predictions, score, k).withColumn("as_of", F.lit(as_of).cast("date"))


def write_topk(
    predictions: DataFrame, score: str, k: int, as_of: str, path: str, fmt: str = "parquet", options: dict[str, str] = {}
) -> int:
    """Append the k best rows, stamped ``as_of``; warns and writes nothing when there are none."""
    rows = topk_rows(predictions, score, k, as_of).persist()  # k rows
    n = rows.count()
    if n == 0:
        log.warning("no predictions to persist")
    else:
        rows.write.mode("append").format(fmt).options(**options).save(path)
    rows.unpersist()
    return n


@dataclass
class FeatureMeta:
    """What scoring needs besides the model."""

    features: list[str]
    horizons: list[int]
    lookback: int
    price_col: str = "open"
    targets: list[str] = field(default_factory=list)
    masks: list[str] = field(default_factory=list)


def save_feature_meta(meta: FeatureMeta, scaler: DataFrame, assets: DataFrame, path: str) -> None:
    """Column roles, horizons, scaler and asset dictionary as small Parquet tables."""
    spark = scaler.sparkSession
    rows = [("feature", i, c) for i, c in enumerate(meta.features)]
    rows += [("target", i, c) for i, c in enumerate(meta.targets)]
    rows += [("mask", i, c) for i, c in enumerate(meta.masks)]
    rows += [("horizon", i, str(h)) for i, h in enumerate(meta.horizons)]
    rows += [("lookback", 0, str(meta.lookback)), ("price_col", 0, meta.price_col)]
    layout = spark.createDataFrame(rows, "kind string, pos int, value string")
    layout.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "layout"))
    scaler.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "scaler"))
    assets.write.mode("overwrite").parquet(os.path.join(path, "assets"))


def load_feature_meta(spark: SparkSession, path: str) -> tuple[FeatureMeta, DataFrame, DataFrame]:
    rows = spark.read.schema("kind string, pos int, value string").parquet(os.path.join(path, "layout")).collect()

    def values(kind: str) -> list[str]:
        return [r["value"] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["pos"])]

    meta = FeatureMeta(
        features=values("feature"),
        horizons=[int(h) for h in values("horizon")],
        lookback=int(values("lookback")[0]),
        price_col=values("price_col")[0],
        targets=values("target"),
        masks=values("mask"),
    )
    scaler = spark.read.schema(scaler_schema()).parquet(os.path.join(path, "scaler"))
    assets = spark.read.schema(f"{SYMBOL} string, asset_id int").parquet(os.path.join(path, "assets"))
    return meta, scaler, assets
