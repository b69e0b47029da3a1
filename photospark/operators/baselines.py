"""Constant and linear baselines, batch scoring and the grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.contract import NAMES, require
from photospark.functions.arrays import all_finite
from photospark.operators import linear


def constant_baseline(data: DataFrame) -> DataFrame:
    """Predict the train mean of each parameter for every row outside train.

    ``data``: (photo, split, parameter, truth). The means are six rows joined on the parameter.
    """
    mean = data.where("split = 'train'").groupBy("parameter").agg(F.avg("truth").alias("pred"))
    return data.where("split <> 'train'").join(mean, "parameter").select(F.lit("constant").alias("model"), "photo", "split", "parameter", "pred", "truth")


def simple_linear_baseline(data: DataFrame, x: str) -> DataFrame:
    """One-feature least squares per parameter, clipped to [-1,1]."""
    fit = data.where("split = 'train'").groupBy("parameter").agg(F.regr_slope("truth", x).alias("_b"), F.regr_intercept("truth", x).alias("_a"))
    pred = F.least(F.greatest(F.col("_a") + F.col("_b") * F.col(x), F.lit(-1.0)), F.lit(1.0))
    return data.where("split <> 'train'").join(fit, "parameter").select(F.lit("linear").alias("model"), "photo", "split", "parameter", pred.alias("pred"), "truth")


def linear_baseline(wide: DataFrame, features: list[str], targets: tuple[str, ...] = NAMES, reg: float = 0.0, fit_intercept: bool = True) -> DataFrame:
    """Least squares on standardised features for all targets from one pass over train, clipped to [-1,1] (``linear.solve``)."""
    train, rest = wide.where("split = 'train'"), wide.where("split <> 'train'")
    model = linear.solve(linear.moments(train, [*features, *targets])[0], len(features), reg, fit_intercept)
    return linear.predict(rest, features, targets, [model]).select(F.lit("physical_linear").alias("model"), "photo", "split", "parameter", "pred", "truth")


def batch_score(feat: DataFrame, make_predict: Callable, width: int = 6, batch: int = 1024, col: str = "x") -> DataFrame:
    """Score an array column with a supplied model, once loaded per Python worker, under an output contract.

    ``make_predict()`` returns a function from an (n, k) array to an (n, width) array. The output must be
    finite with |v| <= 1.000001 and is clipped to [-1,1].
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    size = feat.select(F.size(col)).first()[0]
    score = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[size]])
    scored = require(feat, (F.size(col) == size) & all_finite(F.col(col)), "model input breaks its contract").withColumn("prediction", score(col))
    ok = (F.size("prediction") == width) & all_finite(F.col("prediction")) & F.forall("prediction", lambda v: F.abs(v) <= 1.000001)
    return require(scored, ok, "model output breaks its contract").withColumn(
        "prediction", F.transform("prediction", lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))))


def grid_screen(wide: DataFrame, features: list[str], targets: tuple[str, ...], grid: list[float], seeds: tuple[int, ...] = ()) -> DataFrame:
    """(stage, reg, seed, score): mean absolute validation error of every penalty, then of the best one on seeded resamples of train.

    One pass over train serves all penalties, targets and seeds, one over validation scores the whole grid and one
    the seeds. The best penalty has the least score, ties by the smaller penalty.
    """
    train, val = wide.where("split = 'train'"), wide.where("split = 'val'")
    found = linear.moments(train, [*features, *targets], [F.lit(1), *[linear.poisson_picks(s, "photo") for s in seeds]])

    def scores(stage: str, settings: list[tuple], models: list) -> DataFrame:
        named = wide.sparkSession.createDataFrame([(i, stage, float(reg), seed) for i, (reg, seed) in enumerate(settings)], "model int, stage string, reg double, seed int")
        rows = linear.predict(val, features, targets, models).groupBy("model").agg(F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("score"))
        return named.join(rows, "model").select("stage", "reg", "seed", "score")

    screen = scores("screen", [(reg, None) for reg in grid], [linear.solve(found[0], len(features), reg) for reg in grid])
    # one row per penalty
    rated = screen.collect()
    screen = wide.sparkSession.createDataFrame(rated, screen.schema)
    if not seeds or not rated:
        return screen
    best = min(rated, key=lambda r: (r["score"], r["reg"]))["reg"]
    return screen.unionByName(scores("rerun", [(best, s) for s in seeds], [linear.solve(m, len(features), best) for m in found[1:]]))


def delta(pred: DataFrame, current: DataFrame, key: str = "photo") -> DataFrame:
    """Difference to the caller's values, only where both carry the same version."""
    return pred.join(current.select(key, "version", "parameter", F.col("value").alias("current")), [key, "version", "parameter"]).withColumn(
        "delta", F.col("value") - F.col("current"))
