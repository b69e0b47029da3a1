"""Least squares for many targets, penalties and resamples from one pass over the train rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.contract import require
from photospark.functions.arrays import all_finite
from photospark.functions.text import md5_pick

MAX_COLUMNS = 2_000  # a state is the square of this; the driver solves a system of this size
MERGERS = 32
CONDITION = 1e10
STATE = "model int, n double, mean array<double>, m array<double>"


@dataclass(frozen=True)
class Moments:
    """Weight, means and centred second moments of the columns (features, then targets)."""

    n: float
    mean: object
    m: object


def poisson_picks(seed: int, key: str) -> Column:
    """How often a bootstrap resample holds a row: a Poisson(1) number from the MD5 of seed and key."""
    u = md5_pick(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    shares, term = [], math.exp(-1)
    for k in range(1, 13):
        shares.append(sum(shares[-1:]) + term)
        term /= k
    return sum((F.when(u >= int(s * 2 ** 32), 1).otherwise(0) for s in shares[1:]), F.when(u >= int(shares[0] * 2 ** 32), 1).otherwise(0))


def _merge(states: dict, model: int, n: float, mean, m) -> None:
    """Add one state to the model's: the means differ, so the squares of their distance come on top."""
    import numpy as np

    if n == 0:
        return
    if model not in states:
        states[model] = (n, mean, m)
        return
    n0, mean0, m0 = states[model]
    apart = mean - mean0
    states[model] = (n0 + n, mean0 + apart * (n / (n0 + n)), m0 + m + np.outer(apart, apart) * (n0 * n / (n0 + n)))


def _emit(states: dict):
    import pyarrow as pa

    rows = [(k, float(n), mean.tolist(), m.ravel().tolist()) for k, (n, mean, m) in sorted(states.items())]
    types = [pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["model", "n", "mean", "m"])


def moments(rows: DataFrame, columns: list[str], weights: list[Column] | None = None) -> list[Moments]:
    """Moments of ``columns`` once per weight (one weight of 1 without any), in one pass.

    Every task folds its batches into one state per weight and emits that; states are folded in a few tasks and then in
    one, a state at a time, so no task holds more than two per weight. A row with a null or an endless number fails the
    job; an empty table gives no state and is refused.
    """
    import numpy as np

    width = len(columns)
    if width > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns need an iterative solver")
    weights = weights or [F.lit(1)]
    values = F.array(*[F.col(c).cast("double") for c in columns])
    ready = require(rows.select(values.alias("z"), F.array(*[w.cast("double") for w in weights]).alias("w")), all_finite(F.col("z")), "a row lacks a feature or a target")

    def gather(batches):
        states: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z").flatten().to_numpy().reshape(-1, width)
            for k, w in enumerate(batch.column("w").flatten().to_numpy().reshape(len(z), -1).T):
                n = w.sum()
                if n:
                    mean = w @ z / n
                    off = z - mean
                    _merge(states, k, n, mean, (off * w[:, None]).T @ off)
        yield _emit(states)

    def fold(batches):
        states: dict = {}
        for batch in batches:
            for model, n, mean, m in zip(*(batch.column(c) for c in ("model", "n", "mean", "m"))):
                _merge(states, model.as_py(), n.as_py(), mean.values.to_numpy(), m.values.to_numpy().reshape(width, width))
        yield _emit(states)

    found = ready.mapInArrow(gather, STATE).repartition(MERGERS).mapInArrow(fold, STATE).repartition(1).mapInArrow(fold, STATE).orderBy("model").collect()
    if len(found) != len(weights):
        raise ValueError("no rows to fit")
    return [Moments(r["n"], np.array(r["mean"]), np.array(r["m"]).reshape(width, width)) for r in found]


def solve(found: Moments, features: int, penalty: float = 0.0, intercept: bool = True):
    """(features + 1, targets) coefficients, the intercept last, of the least mean square plus ``penalty`` times the squares
    of the coefficients of standardised features.

    The system is that of correlations, so scales don't matter. It is solved by Cholesky when its condition is under 1e10;
    beyond, the directions below that share are left out, which is the solution of least norm. A feature without variance
    gets 0.
    """
    import numpy as np

    m = found.m / found.n
    if not intercept:
        m = m + np.outer(found.mean, found.mean)
    spread = np.sqrt(np.clip(np.diag(m)[:features], 0, None))
    # what is left of a constant after summation isn't variance
    alive = spread > 1e-12 * np.maximum(np.abs(found.mean[:features]), 1e-300)
    scale = np.where(alive, spread, 1.0)
    system = (m[:features, :features] / np.outer(scale, scale))[np.ix_(alive, alive)] + penalty * np.eye(int(alive.sum()))
    right = (m[:features, features:] / scale[:, None])[alive]
    values, vectors = np.linalg.eigh(system) if len(system) else (np.zeros(0), np.zeros((0, 0)))
    if len(system) and values[0] * CONDITION > values[-1]:
        lower = np.linalg.cholesky(system)
        found_b = np.linalg.solve(lower.T, np.linalg.solve(lower, right))
    else:
        kept = values * CONDITION > (values[-1] if len(values) else 0)
        found_b = vectors[:, kept] @ ((vectors[:, kept].T @ right) / values[kept, None])
    out = np.zeros((features + 1, m.shape[1] - features))
    out[:-1][alive] = found_b / scale[alive][:, None]
    if intercept:
        out[-1] = found.mean[features:] - found.mean[:features] @ out[:-1]
    return out


def predict(rows: DataFrame, features: list[str], targets: tuple[str, ...], models: list, keep: tuple[str, ...] = ("photo", "split")) -> DataFrame:
    """(model, keep.., parameter, pred, truth): clipped predictions of all models and targets in one pass."""
    import numpy as np

    names, width = list(targets), len(features)
    packed = np.concatenate(models, axis=1)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            n, count = batch.num_rows, packed.shape[1]
            x = batch.column("_x").flatten().to_numpy().reshape(n, width)
            y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).reshape(n, len(names))
            pred = np.clip(x @ packed[:-1] + packed[-1], -1, 1)
            at = pa.array(np.repeat(np.arange(n), count))
            which = np.tile(np.arange(count), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array((which // len(names)).astype(np.int32)), *[batch.column(c).take(at) for c in keep], pa.array(names).take(pa.array(which % len(names))), pa.array(pred.ravel()),
                 pa.array(np.tile(y, (1, len(models))).ravel(), from_pandas=True)], names=["model", *keep, "parameter", "pred", "truth"])

    array = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    ready = require(rows.select(*keep, array(features).alias("_x"), array(targets).alias("_y")), all_finite(F.col("_x")), "a row lacks a feature")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return ready.mapInArrow(score, f"model int, {kinds}, parameter string, pred double, truth double")
