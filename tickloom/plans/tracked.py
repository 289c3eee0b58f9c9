"""Fitting with validation: a loss per epoch, the best state kept, an early stop, and state to resume from.

An epoch is one aggregate over a stored design table that holds training and validation rows: losses of
both, and gradient and curvature of the training loss at the present coefficients. The step is a damped
Newton step on the smooth L1 loss with weight decay.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.scaler import NoTrainingRows
from tickloom.plans.design import design_table, sums_over
from tickloom.plans.training import Forecaster

_EPOCH = "epoch int, train_loss double, val_loss double, best boolean"


@dataclass
class TrackedState:
    """All a stopped run needs to go on: coefficients (a row per horizon) now and at the best epoch, and the history."""

    coefficients: list[list[float]]
    best: list[list[float]]
    best_loss: float | None = None
    best_epoch: int = -1
    bad: int = 0
    stopped: bool = False
    history: list[tuple[int, float, float | None]] = field(default_factory=list)


def _latest(spark: SparkSession, path: str) -> TrackedState | None:
    """The newest complete state below ``path``; a folder without its success mark is one that was being written."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(place) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    epochs = sorted(int(n.split("=")[1]) for n in done if n.startswith("epoch="))
    if not epochs:
        return None
    told = json.loads(spark.read.schema("told string").parquet(f"{path}/epoch={epochs[-1]}").first()["told"])
    return TrackedState(**told | {"history": [tuple(h) for h in told["history"]]})


def _sums(theta: np.ndarray):
    n_targets, p = theta.shape

    def sums(x, y, val):
        out = []
        for role in (False, True):
            some = np.flatnonzero(val == role)
            inputs = x[some]
            residual = y[some].T - theta @ inputs.T
            size = np.abs(residual)
            out += [[float(len(some))], [float(np.where(size < 1, 0.5 * residual * residual, size - 0.5).sum())]]
            if not role:
                out.append((np.clip(residual, -1, 1) @ inputs).ravel())
                for i in range(n_targets):
                    near = inputs[size[i] < 1]
                    out.append((near.T @ near).ravel())
        return np.concatenate(out)

    return sums, 4 + n_targets * (p + p * p)


def fit_tracked(
    train: DataFrame,
    val: DataFrame,
    features: list[str],
    horizons: list[int],
    lookback: int,
    scaler: dict,
    epochs: int = 15,
    rate: float = 0.5,
    decay: float = 1e-4,
    patience: int = 2,
    min_delta: float = 1e-4,
    inputs: list[str] | None = None,
    state: str | None = None,
) -> tuple[Forecaster, DataFrame]:
    """The forecaster with the least validation loss of all epochs, and the history of the epochs.

    Starts from zero coefficients. An epoch is better if it undercuts the best validation loss by ``min_delta``;
    after more than ``patience`` epochs that are not, the run stops. Without validation rows no epoch is better
    than another and the last one counts. With ``state``, a folder all executors can reach, every epoch is
    written there, and a later call with the same rows goes on after the last one. Rows with missing or
    infinite values are left out; without any training row ``NoTrainingRows`` is raised.
    """
    spark = train.sparkSession
    fc = Forecaster(features, horizons, lookback, scaler, chosen=inputs)
    names = fc.inputs()
    p, k = len(names) + 1, len(horizons)
    both = train.select("y", *names, F.lit(False).alias("val")).unionByName(val.select("y", *names, F.lit(True).alias("val")))
    design = design_table(both, names, k, F.col("val"))
    now = (_latest(spark, state) if state else None) or TrackedState(np.zeros((k, p)).tolist(), np.zeros((k, p)).tolist())
    while len(now.history) < epochs and not now.stopped:
        theta = np.array(now.coefficients)
        sums, size = _sums(theta)
        out = sums_over(design, sums, size, p, k, 1)
        n, loss, rest = float(out[0]), float(out[1]), out[2:]
        n_val, val_loss = float(rest[-2]), float(rest[-1] / max(rest[-2] * k, 1))
        if not n:
            raise NoTrainingRows("no training row is left to fit on")
        epoch = len(now.history)
        now.history.append((epoch, loss / (n * k), val_loss if n_val else None))
        if not n_val or now.best_loss is None or val_loss < now.best_loss - min_delta:
            now.best, now.best_loss, now.best_epoch, now.bad = theta.tolist(), val_loss if n_val else None, epoch, 0
        else:
            now.bad += 1
            now.stopped = now.bad > patience
        grad = rest[: k * p].reshape(k, p) / n
        curve = rest[k * p : k * (p + p * p)].reshape(k, p, p) / n
        keep = decay * np.diag(np.r_[0.0, np.ones(p - 1)])
        for i in range(k):
            theta[i] += rate * np.linalg.solve(curve[i] + keep + 1e-12 * np.eye(p), grad[i] - keep @ theta[i])
        now.coefficients = theta.tolist()
        if state:
            spark.createDataFrame([(json.dumps(asdict(now)),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
    fc.linear = now.best
    rows = [(e, t, v, e == now.best_epoch) for e, t, v in now.history]
    return fc, spark.createDataFrame(rows, _EPOCH)


