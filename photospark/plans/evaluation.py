"""Labels to stratified metrics in one plan: consensus, whole-group split, train-only thresholds, baselines, strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.contract import bound
from photospark.operators import metrics as M
from photospark.operators.labels import expert_targets
from photospark.operators.splits import group_split
from photospark.session import cut_lineage


def fit_and_predict(truth: DataFrame, x: str) -> DataFrame:
    """Constant and one-feature linear baselines from a single pass over the train rows."""
    fits = truth.where("split = 'train'").groupBy("parameter").agg(
        F.avg("truth").alias("_c"), F.regr_slope("truth", x).alias("_b"), F.regr_intercept("truth", x).alias("_a"))
    line = F.least(F.greatest(F.col("_a") + F.col("_b") * F.col(x), F.lit(-1.0)), F.lit(1.0))
    models = F.explode(F.array(F.struct(F.lit("constant").alias("model"), F.col("_c").alias("pred")), F.struct(F.lit("linear").alias("model"), line.alias("pred"))))
    return truth.where("split <> 'train'").join(fits, "parameter").select("photo", "split", "parameter", "truth", models.alias("_m")).select(
        "_m.model", "photo", "split", "parameter", "_m.pred", "truth")


def strata_report(labels: DataFrame, features: DataFrame, photos: DataFrame, tags: DataFrame, experts: list[str], x: str, lightness: str) -> DataFrame:
    """Metrics per (bucket, model) on validation and test photos.

    ``labels``: (photo, expert, parameter, value); ``features``: (photo, ...); ``photos``: (photo, group_id, camera);
    ``tags``: (photo, tag). The joined truth table feeds four branches, so it is written once.
    """
    splits = group_split(photos, key="photo")
    lo, hi = bound("parameter", "lo"), bound("parameter", "hi")
    joined = expert_targets(labels, experts).join(splits.select("photo", "split"), "photo").join(features.select("photo", x), "photo")
    truth = cut_lineage(joined.withColumn("truth", (F.col("mean") - lo) * 2 / (hi - lo) - 1))
    train = features.join(splits.where("split = 'train'").select("photo"), "photo", "left_semi")
    bands = M.brightness_band(features, M.fit_thresholds(train, lightness, {"lower": 1 / 3, "upper": 2 / 3}), lightness)
    tails = M.tail_buckets(truth, M.fit_tails(truth.where("split = 'train'")))
    buckets = M.photo_buckets(bands.select("photo", "band"), photos.select("photo", "camera"), tags, tails)
    return M.stratified_metrics(M.with_errors(fit_and_predict(truth, x)), buckets)
