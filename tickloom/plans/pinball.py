"""Quantile regression on the pinball loss over a stored design table.

First the kink of the loss is rounded over a band of half-width ``h`` around zero, which makes Newton
steps possible, and the band narrows along the path of its optima. Every step is one aggregate that evaluates
all models (horizon x quantile) at several step lengths together. Once a band holds few rows, these are
all that is left to decide: with the other rows' sides fixed, the optimum is found among them exactly, by
moving from vertex to vertex as the simplex method does, and this is repeated until the loss falls no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.design import chunks, design_table, least_squares, sums_over

#: Step lengths tried at a time, and the part of the band that is kept after a step.
STEPS = (1.0, 0.5, 0.2, 0.05, 0.0)
NARROWER = 0.2
#: A band is narrowed once a step moves its rows by no more than this part of it.
SETTLED = 0.2
#: Different rows decided exactly, per model: a bound on what reaches the driver.
NEAR_ROWS = 2048
#: Half-width of the last band, in deviations of the residuals, and bounds on steps and rounds.
LAST_BAND = 1e-7
MAX_STEPS = 60
MAX_ROUNDS = 24
#: Ever shorter moves tried towards a vertex that is no better.
MAX_TRIES = 3


def pinball(residual: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.maximum(q * residual, (q - 1) * residual)


def band_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, move: np.ndarray, target: np.ndarray, q: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per model the rounded loss after each of ``STEPS`` along ``move``; then, after the first of them, the gradient, how
    it changes with the band, its curvature, and the rows in the band."""
    models, p = theta.shape
    # a model's rows lie next to each other: numpy's inner loops run over rows
    start, change = np.ascontiguousarray(y.T)[target] - theta @ x.T, move @ x.T
    losses, wide = np.empty((len(STEPS), models)), h[:, None]
    for i in reversed(range(len(STEPS))):
        residual = start - STEPS[i] * change
        size = np.abs(residual)
        short = np.maximum(wide - size, 0.0)
        losses[i] = size.sum(1) / 2 + np.einsum("ij,ij->i", short, short) / (4 * h) + (q - 0.5) * residual.sum(1)
    slope = np.clip(residual / (2 * wide), -0.5, 0.5) + (q - 0.5)[:, None]
    drift, curve, rows = np.empty((models, p)), np.empty((models, p * p)), np.empty((models, 1))
    for m in range(models):
        near = np.flatnonzero(size[m] < h[m])
        some = x[near]
        drift[m], curve[m], rows[m] = residual[m, near] @ some / (2 * h[m] ** 2), (some.T @ some / (2 * h[m])).ravel(), len(near)
    return np.concatenate([losses.T, -(slope @ x), drift, curve, rows], axis=1).ravel()


def narrowing(evaluate, theta: np.ndarray, spread: np.ndarray, rows: float, unit: np.ndarray) -> np.ndarray:
    """Newton steps in ever narrower bands, until a band holds less than half of ``NEAR_ROWS``.

    From one band to the next a model follows the path of the optima to first order. Where many rows have one
    target, its residual shrinks with the band on this path, and Newton steps alone would lose these rows from the band.
    ``theta`` has one row per model, ``spread`` the deviation of its residuals; ``evaluate(theta, move, model, h)`` gives
    ``band_sums``. Columns of ``unit`` are ways along which a step of one moves the forecasts of all rows by one in mean square;
    along none of them a step goes farther than the band, which may hold too few rows of a rare kind to tell their curvature.
    """
    models, p = theta.shape
    h, move = np.maximum(spread, 1e-300), np.zeros_like(theta)
    active, stuck, slopes_here = (spread > 0) & (rows > NEAR_ROWS), np.zeros(models, int), np.zeros(models, bool)
    for _ in range(MAX_STEPS):
        which = np.flatnonzero(active)
        if not len(which):
            break
        told = evaluate(theta[which], move[which], which, h[which]).reshape(len(which), -1)
        for losses, parts, m in zip(told[:, : len(STEPS)], told[:, len(STEPS) :], which):
            best = int(np.argmin(losses)) if slopes_here[m] else 0
            theta[m] += STEPS[best] * move[m]
            if best:
                # slopes are those after a full step: where a part of it is better the next pass gives them
                slopes_here[m], stuck[m] = False, stuck[m] + 1 if STEPS[best] == 0.0 else 0
                if stuck[m] == 1:
                    move[m], slopes_here[m] = STEPS[-2] / 4 * move[m], True
                    continue
                if stuck[m]:
                    active[m], h[m], stuck[m] = h[m] > LAST_BAND * spread[m], h[m] * NARROWER, 0
                move[m] = 0.0
                continue
            slopes_here[m], stuck[m] = True, 0
            grad, drift, curve, near = parts[:p], parts[p : 2 * p], parts[2 * p : 2 * p + p * p].reshape(p, p), parts[-1]
            sizes, ways = np.linalg.eigh(unit.T @ curve @ unit)
            sizes, ways = np.maximum(sizes, 1e-10 * max(sizes[-1], 1e-300)), unit @ ways

            def solved(v, ways=ways, sizes=sizes, most=h[m]):
                return ways @ np.clip((ways.T @ v) / sizes, -most, most)

            move[m] = -solved(grad)
            if 2 * (move[m] @ curve @ move[m]) <= SETTLED**2 * h[m] * max(near, 1.0):
                # the next step moves the rows of the band by a small part of it
                active[m] = near > NEAR_ROWS / 2 and h[m] > LAST_BAND * spread[m]
                move[m] += (1 - NARROWER) * solved(h[m] * drift)
                h[m] *= NARROWER
    return theta


def vertex(theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, q: float, pull: np.ndarray) -> np.ndarray:
    """The optimum of the weighted pinball loss over a few rows less ``pull @ theta``, from vertex to vertex.

    Starts at the rows nearest to ``theta`` that determine it. Where they do not, or where the rows leave the
    optimum open, ``theta`` is moved as little as possible or left at the last vertex.
    """
    basis, kept = [], []
    for i in np.argsort(np.abs(y - x @ theta), kind="stable"):
        rest = x[i].astype(float)
        for b in kept:
            rest = rest - (rest @ b) * b
        size = np.linalg.norm(rest)
        if size > 1e-7 * np.linalg.norm(x[i]):
            basis.append(int(i))
            kept.append(rest / size)
        if len(basis) == x.shape[1]:
            break
    if len(basis) == 0:
        return theta
    theta = theta + np.linalg.lstsq(x[basis], (y - x @ theta)[basis], rcond=1e-12)[0]
    if len(basis) < x.shape[1]:
        return theta
    for _ in range(20 * x.shape[1] + len(x)):
        residual = y - x @ theta
        residual[basis] = 0.0
        free = np.ones(len(x), bool)
        free[basis] = False
        # a row on the fit that is not in the basis may lean either way: it counts half of its range
        lean = np.where(residual > 0, q, np.where(residual < 0, q - 1, q - 0.5)) * weight
        inverse = np.linalg.inv(x[basis])
        duals = -(inverse.T @ (pull + (lean[free, None] * x[free]).sum(0)))
        over, under = duals - q * weight[basis], (q - 1) * weight[basis] - duals
        j = int(np.argmax(np.maximum(over, under)))
        if max(over[j], under[j]) <= 1e-9 * max(weight.sum(), 1.0):
            break
        side = -1.0 if over[j] > under[j] else 1.0
        way = side * inverse[:, j]
        step = x @ way
        with np.errstate(divide="ignore", invalid="ignore"):
            when = np.where(free & (np.abs(step) > 1e-12), residual / step, -1.0)
        ahead = np.flatnonzero(when > 0)
        ahead = ahead[np.argsort(when[ahead], kind="stable")]
        slope = -max(over[j], under[j]) + np.cumsum(np.abs(step[ahead]) * weight[ahead])
        if not len(ahead) or slope[-1] < 0:
            break
        enters = int(ahead[np.argmax(slope >= 0)])
        theta = theta + when[enters] * way
        basis[j] = enters
    return theta


def fit_pinball(rows: DataFrame, inputs: list[str], horizons: list[int], quantiles: list[float]) -> dict[tuple[int, float], list[float]]:
    """Coefficients (intercept first) per horizon and quantile that minimise the pinball loss over ``rows``.

    ``rows`` have the inputs and ``y``, one entry per horizon; those with a missing or infinite value are left out.
    Where the optimum is not unique, one of the optima is found. Raises ``ValueError`` if no row is left.
    """
    return solve_tables(design_table(rows, inputs, len(horizons)), len(inputs) + 1, horizons, quantiles)[0]


def solve_tables(design: DataFrame, width: int, horizons: list[int], quantiles: list[float]) -> tuple[dict[tuple[int, float], list[float]], dict[tuple[int, float], float], int]:
    """As ``fit_pinball`` over a stored design table; also the summed loss of every model, and the rows."""
    n_targets = len(horizons)
    n, start, spread, products = least_squares(design, width, n_targets)
    if not n:
        raise ValueError("no usable row to fit quantiles on")
    target = np.repeat(np.arange(n_targets), len(quantiles))
    q = np.tile(np.asarray(quantiles, float), n_targets)

    def evaluate(theta, move, of, h):
        t, level = target[of], q[of]
        return sums_over(design, lambda x, y: band_sums(x, y, theta, move, t, level, h), len(of) * (len(STEPS) + 1 + 2 * width + width * width), width, n_targets)

    kinds, ways = np.linalg.eigh(products / n)
    unit = ways[:, kinds > 1e-12 * kinds[-1]] / np.sqrt(kinds[kinds > 1e-12 * kinds[-1]])
    theta = narrowing(evaluate, start[target].copy(), spread[target], n, unit)
    loss, moved, open_, tries = np.full(len(q), np.inf), theta.copy(), np.ones(len(q), bool), np.zeros(len(q), int)
    for _ in range(MAX_ROUNDS):
        if not open_.any():
            break
        near = _near_rows(design, moved, target, open_, n_targets)
        found, pull = _outside(design, moved, target, q, [layers for layers, _ in near], n_targets)
        for m in np.flatnonzero(open_):
            if found[m] < loss[m] * (1 - 1e-13):
                theta[m], loss[m], tries[m] = moved[m], found[m], 0
                moved[m] = vertex(theta[m], *near[m][1], q[m], pull[m])
            else:
                # the way goes down, but this far rows have changed sides that it took for fixed
                tries[m] += 1
                moved[m] = theta[m] + (moved[m] - theta[m]) / 4
            open_[m] = tries[m] < MAX_TRIES and np.abs(moved[m] - theta[m]).max() > 1e-11 * np.abs(theta[m]).max()
    keys = [(horizons[i], float(level)) for i, level in zip(target, q)]
    return {k: [float(v) for v in b] for k, b in zip(keys, theta)}, {k: float(v) for k, v in zip(keys, loss)}, int(n)


#: Rows decided exactly: those within a reach of the fit, or of these only the ones outside a span of inputs.
_Layer = tuple[np.ndarray | None, float]


def _outside(design: DataFrame, theta: np.ndarray, target: np.ndarray, q: np.ndarray, layers: list[list[_Layer]], n_targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed loss of every model, and the pull of the rows that none of its layers holds."""
    width = theta.shape[1]

    def sums(x, y):
        residual = np.ascontiguousarray(y.T)[target] - theta @ x.T
        near = np.zeros(residual.shape, bool)
        for m, held in enumerate(layers):
            for beyond, reach in held:
                inside = np.abs(residual[m]) <= reach
                near[m] |= inside if beyond is None else inside & (((x @ beyond) ** 2).sum(1) > _SPAN)
        level = q[:, None]
        lean = np.where(near, 0.0, np.where(residual < 0, level - 1, level))
        return np.concatenate([pinball(residual, level).sum(1)[:, None], lean @ x], axis=1).ravel()

    out = sums_over(design, sums, len(q) * (1 + width), width, n_targets).reshape(len(q), -1)
    return out[:, 0], out[:, 1:]


def _near_rows(design: DataFrame, theta: np.ndarray, target: np.ndarray, wanted: np.ndarray, n_targets: int) -> list[tuple[list[_Layer], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Per ``wanted`` model layers and their rows (inputs, target, how often): the nearest rows, then the nearest of those
    with inputs that the ones before do not span, so that a rare kind of rows is decided as well as a frequent one.

    A pass finds a layer of all models that still need one.
    """
    models = len(theta)
    layers, parts = [[] for _ in range(models)], [[] for _ in range(models)]
    beyond, more = [None] * models, np.array(wanted, bool)
    while more.any():
        which = np.flatnonzero(more)
        found = _nearest(design, theta[which], target[which], [beyond[m] for m in which], n_targets)
        for m, (x, y, weight, reach) in zip(which, found):
            more[m] = False
            if not len(x):
                continue
            layers[m].append((beyond[m], reach))
            parts[m].append((x, y, weight))
            _, sizes, kinds = np.linalg.svd(np.concatenate([p[0] for p in parts[m]]), full_matrices=True)
            missing = np.r_[sizes, np.zeros(len(kinds) - len(sizes))] <= 1e-9 * sizes[0]
            if reach == np.inf and beyond[m] is None or not missing.any():
                continue
            beyond[m], more[m] = kinds[missing].T, True
    none = np.zeros((0, theta.shape[1])), np.zeros(0), np.zeros(0)
    return [(layers[m], tuple(np.concatenate([p[i] for p in parts[m]]) for i in range(3)) if parts[m] else none) for m in range(models)]


#: Squared part of a row's inputs outside a span from which on it counts as outside.
_SPAN = 1e-12


def _least(rows: list[np.ndarray], most: int) -> np.ndarray:
    """The ``most`` different rows (distance, target, inputs, and how often as the last column) that are nearest."""
    all_ = np.concatenate(rows)
    # -0.0 and 0.0 are one value
    order = np.lexsort((all_ + 0.0)[:, -2:0:-1].T)
    all_ = all_[order]
    first = np.flatnonzero(np.r_[True, (all_[1:, 1:-1] != all_[:-1, 1:-1]).any(1)])
    kept = all_[first]
    kept[:, 0], kept[:, -1] = np.minimum.reduceat(all_[:, 0], first), np.add.reduceat(all_[:, -1], first)
    return kept[np.argsort(kept[:, 0], kind="stable")[:most]]


def _nearest(
    design: DataFrame, theta: np.ndarray, target: np.ndarray, beyond: list[np.ndarray | None], n_targets: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Per model the different rows of least residual (inputs, target, how often), and a bound between them and the others.

    One pass for all models. A task keeps its nearest rows of each, and what is shuffled are these.
    """
    models, width = theta.shape
    most = NEAR_ROWS + 1
    names = ["far", "v", *[f"x{i}" for i in range(width)], "n"]

    def partial(batches):
        limit, held, waiting = np.full(models, np.inf), [[] for _ in range(models)], np.zeros(models, int)

        def shrink(m):
            held[m], waiting[m] = [_least(held[m], most)], 0
            if len(held[m][0]) == most:
                limit[m] = held[m][0][-1, 0]

        for part in chunks(batches, width + n_targets):
            x, y = part[:, :width], part[:, width:]
            far = np.abs(np.ascontiguousarray(y.T)[target] - theta @ x.T)
            for m in range(models):
                near = far[m] <= limit[m]
                if beyond[m] is not None:
                    near &= ((x @ beyond[m]) ** 2).sum(1) > _SPAN
                at = np.flatnonzero(near)
                if len(at):
                    held[m].append(np.column_stack([far[m, at], y[at, target[m]], x[at], np.ones(len(at))]))
                    waiting[m] += len(at)
                    if waiting[m] > 2 * most:
                        shrink(m)
        for m in range(models):
            if held[m]:
                rows = _least(held[m], most)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), m, "int32")), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names=["m", *names])

    told = design.mapInArrow(partial, "m int, " + ", ".join(f"{n} double" for n in names))
    row = names[1:-1]
    different = told.groupBy("m", *row).agg(F.sum("n").alias("n"), F.min("far").alias("far"))
    ranked = different.withColumn("_rank", F.row_number().over(Window.partitionBy("m").orderBy("far", *row))).where(F.col("_rank") <= most)
    table = ranked.select("m", *names).toArrow()
    of, data = table.column("m").to_numpy(), np.column_stack([table.column(n).to_numpy() for n in names])
    out = []
    for m in range(models):
        near = data[of == m]
        near = near[np.lexsort((*near[:, -2:0:-1].T, near[:, 0]))] if len(near) else near
        reach = np.inf
        if len(near) > NEAR_ROWS:
            far = near[:, 0]
            # cut where residuals differ by more than rounding
            gaps = np.flatnonzero(np.diff(far) > 1e-12 * max(far[-1], 1e-300))
            cut = int(gaps[-1]) + 1 if len(gaps) else 0
            near, reach = near[:cut], (far[cut - 1] + far[cut]) / 2 if cut else -1.0
        out.append((near[:, 2:-1], near[:, 1], near[:, -1], float(reach)))
    return out
