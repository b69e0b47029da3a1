"""Baselines' evaluation: errors, overlapping strata, thresholds fitted on train, rankings and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.contract import NAMES, bound, require
from photospark.functions.color import mired, psnr
from photospark.operators.quantiles import exact_percentiles, global_rank, percentile_struct
from photospark.session import one_row

Metric = Callable[[], list[Column]]


def _raw(v: Column) -> Column:
    p = "parameter"
    return (v + 1) / 2 * (bound(p, "hi") - bound(p, "lo")) + bound(p, "lo")


def with_errors(pred: DataFrame) -> DataFrame:
    """Add normalised and absolute-scale errors to rows (model, photo, parameter, pred, truth)."""
    clipped = F.least(F.greatest(F.col("pred"), F.lit(-1.0)), F.lit(1.0))
    return (
        pred.withColumn("abs_norm", F.abs(F.col("pred") - F.col("truth")))
        .withColumn("raw_pred", _raw(clipped)).withColumn("raw_truth", _raw(F.col("truth")))
        .withColumn("raw_error", F.col("raw_pred") - F.col("raw_truth"))
    )


def regression_metrics(errors: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, parameter): normalised MAE, MAE, RMSE and, for temperature, mired MAE."""
    warm = F.when(F.col("parameter") == "Temperature", F.abs(mired(F.col("raw_pred")) - mired(F.col("raw_truth"))))
    return errors.groupBy(*by, "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_norm").alias("normalized_mae"), F.avg(F.abs("raw_error")).alias("mae"),
        F.sqrt(F.avg(F.col("raw_error") * F.col("raw_error"))).alias("rmse"), F.avg(warm).alias("mired_mae"))


def summary_columns() -> list[Column]:
    """Default metric plug-in: macro error and the two-field score, as aggregate columns."""
    of = lambda name: F.avg(F.when(F.col("parameter") == name, F.col("abs_norm")))
    return [F.avg("abs_norm").alias("macro_normalized_mae"), ((of("Exposure") + of("HighlightRecovery")) / 4).alias("p2")]


def summary_metrics(errors: DataFrame, by: list[str], metric: Metric = summary_columns) -> DataFrame:
    """Aggregate any metric plug-in per group; the plug-in returns columns, so it stays inside Catalyst."""
    return errors.groupBy(*by).agg((F.count(F.lit(1)) / len(NAMES)).cast("long").alias("photos"), *metric())


def two_field_score(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Per photo score of the two delivered fields in raw units, with their errors."""
    of = lambda name, c: F.max(F.when(F.col("parameter") == name, c))
    return errors.groupBy(*keys).agg(
        of("Exposure", F.col("raw_error")).alias("exposure_error"), of("HighlightRecovery", F.col("raw_error")).alias("recovery_error"),
    ).withColumn("p2", (F.abs("exposure_error") / 8 + F.abs("recovery_error") / 100) / 2)


# ---------------------------------------------------------------- thresholds and strata


def fit_standardizer(feat: DataFrame, cols: list[str], floor: float | None = None) -> DataFrame:
    """(feature, mean, scale) of the train rows given; zero deviation becomes 1, or ``floor`` where set."""
    stats = feat.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols])
    long = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_m").alias("mean"), F.col(f"{c}_s").alias("scale")) for c in cols
    ])).alias("_e")).select("_e.*")
    fixed = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")) if floor is None else F.greatest("scale", F.lit(floor))
    return long.withColumn("scale", fixed)


def standardize(feat: DataFrame, cols: list[str], fitted: DataFrame) -> DataFrame:
    """Apply a fitted standardiser; its few numbers arrive as one scalar row."""
    wide = fitted.agg(*[F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(c) for c in cols])
    with_row = feat.withColumn("_s", one_row(wide))
    return with_row.withColumns({c: (F.col(c) - F.col(f"_s.{c}.mean")) / F.col(f"_s.{c}.scale") for c in cols}).drop("_s")


def fit_thresholds(train: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row of exact percentiles of the train rows."""
    return percentile_struct(train, value, probs)


def fit_tails(train: DataFrame, value: str = "mean") -> DataFrame:
    """(parameter, p1, p99) of the train rows."""
    q = exact_percentiles(train, ["parameter"], value, [0.01, 0.99])
    return q.groupBy("parameter").agg(F.max(F.when(F.col("p") < 0.5, F.col("value"))).alias("p1"), F.max(F.when(F.col("p") > 0.5, F.col("value"))).alias("p99"))


def brightness_band(df: DataFrame, thresholds: DataFrame, value: str = "lightness") -> DataFrame:
    """dark / middle / bright from thresholds (lower, upper) fitted on train."""
    t = df.withColumn("_t", one_row(thresholds.select("lower", "upper")))
    band = F.when(F.col(value) <= F.col("_t.lower"), "dark").when(F.col(value) > F.col("_t.upper"), "bright").otherwise("middle")
    return t.withColumn("band", band).drop("_t")


def photo_buckets(photos: DataFrame, cameras: DataFrame, tags: DataFrame, tails: DataFrame, key: str = "photo") -> DataFrame:
    """(photo, bucket) rows of overlapping strata: brightness, camera or unknown, tags or untagged, tails."""
    base = photos.join(cameras.select(key, "camera"), key, "left")
    fixed = base.select(key, F.explode(F.array(
        F.concat(F.lit("brightness/"), "band"), F.concat(F.lit("camera/"), F.coalesce("camera", F.lit("unknown"))))).alias("bucket"))
    tagged = photos.select(key).join(tags.select(key, "tag"), key, "left").select(
        key, F.concat(F.lit("catalog_tag/"), F.coalesce("tag", F.lit("untagged"))).alias("bucket"))
    return fixed.unionByName(tagged).unionByName(tails.select(key, "bucket"))


def tail_buckets(targets: DataFrame, tails: DataFrame, key: str = "photo") -> DataFrame:
    """(photo, bucket) for targets outside the train range of their parameter."""
    out = targets.join(tails, "parameter").where((F.col("mean") < F.col("p1")) | (F.col("mean") > F.col("p99")))
    return out.select(key, F.concat(F.lit("tail/"), "parameter").alias("bucket"))


def stratified_metrics(errors: DataFrame, buckets: DataFrame, key: str = "photo", metric: Metric = summary_columns, small: int = 10) -> DataFrame:
    """Metrics per (bucket, model) over overlapping strata with a small-group flag."""
    joined = errors.join(buckets, key)
    return small_group_flag(summary_metrics(joined, ["bucket", "model"], metric), small)


def small_group_flag(df: DataFrame, n: int = 10, count: str = "photos") -> DataFrame:
    """Keep small groups, but say so."""
    return df.withColumn("small", F.col(count) < n)


def failure_strata(scores: DataFrame, bands: DataFrame, key: str = "photo") -> DataFrame:
    """Per (band, model): score, field errors and signed exposure bias."""
    return scores.join(bands.select(key, "band"), key).groupBy("band", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p2").alias("p2"), F.avg(F.abs("exposure_error")).alias("exposure_mae"),
        F.avg(F.abs("recovery_error")).alias("recovery_mae"), F.avg("exposure_error").alias("exposure_bias"))


def error_correlation(df: DataFrame, error: str, spread: str, by: list[str]) -> DataFrame:
    """Pearson correlation of absolute error and expert disagreement."""
    return df.groupBy(*by).agg(F.corr(F.abs(error), spread).alias("correlation"))


def worst_share(df: DataFrame, score: str, k: int, key: str = "photo") -> DataFrame:
    """Share of the total error held by the ``k`` worst rows (top-k, no global window)."""
    worst = worst_k(df, score, k, key).agg(F.sum(score).alias("s")).scalar()
    return df.agg(F.sum(score).alias("_t")).select((worst / F.col("_t")).alias("share"))


def worst_k(df: DataFrame, score: str, k: int, key: str = "photo") -> DataFrame:
    """The ``k`` largest errors, ties by id."""
    return df.orderBy(F.desc(score), key).limit(k)


def rank_errors(df: DataFrame, score: str, key: str = "photo") -> DataFrame:
    """Stable error ranking of the whole table without a single-task window."""
    return global_rank(df, [F.desc(score), F.col(key)])


def order_picks(df: DataFrame, score: str, key: str = "photo") -> DataFrame:
    """First id and the rows at rank round(.05(n-1)) and round(.95(n-1)) by (score, id)."""
    ranked = global_rank(df.select(key, score), [F.col(score), F.col(key)])
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    want = ranked.withColumn("_n", n)
    pick = (F.when(F.col("rank") - 1 == F.rint((F.col("_n") - 1) * 0.05), "low").when(F.col("rank") - 1 == F.rint((F.col("_n") - 1) * 0.95), "high"))
    ends = want.withColumn("pick", pick).where("pick IS NOT NULL").select("pick", key, score)
    first = df.select(F.lit("first").alias("pick"), key, score).orderBy(key).limit(1)
    return ends.unionByName(first)


def win_fraction(scores: DataFrame, model: str, rivals: list[str], score: str = "p2", key: str = "photo") -> DataFrame:
    """Share of photos on which ``model`` beats each rival."""
    wide = scores.groupBy(key).agg(*[F.max(F.when(F.col("model") == m, F.col(score))).alias(m) for m in [model, *rivals]])
    return wide.agg(*[F.avg((F.col(model) < F.col(r)).cast("double")).alias(f"beats_{r}") for r in rivals])


def matched_ids(pred: DataFrame, base: DataFrame, key: str = "photo") -> DataFrame:
    """Predictions restricted to ids that have a comparable baseline (left semi)."""
    return pred.join(base.select(key).distinct(), key, "left_semi")


def coverage(pred: DataFrame, base: DataFrame, key: str = "photo") -> DataFrame:
    """Matched and total ids with their ratio."""
    total = pred.select(key).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return matched_ids(pred.select(key).distinct(), base, key).agg(F.count(F.lit(1)).alias("matched")).withColumn("total", total).withColumn(
        "coverage", F.col("matched") / F.col("total"))


def align(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Join predictions to truth; an id missing on either side fails the job."""
    both = pred.withColumn("_p", F.lit(1)).join(truth.withColumn("_t", F.lit(1)), keys, "full")
    return require(both, F.col("_p").isNotNull() & F.col("_t").isNotNull(), "predictions and truth cover different ids").drop("_p", "_t")


def same_rows(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the number of rows found on one side only (both zero when equal)."""
    one, two = (side.select(*cols, F.lit(w).cast("long").alias("_w")) for side, w in ((a, 1), (b, -1)))
    net = one.unionByName(two).groupBy(*cols).agg(F.sum("_w").alias("w"))
    return net.agg(F.coalesce(F.sum(F.greatest("w", F.lit(0))), F.lit(0)).alias("only_first"),
                   F.coalesce(F.sum(F.greatest(-F.col("w"), F.lit(0))), F.lit(0)).alias("only_second"))


def compare_versions(a: DataFrame, b: DataFrame, key: str, inputs: list[str], outputs: list[str], error: str) -> DataFrame:
    """One row: shared ids, equal inputs, changed outputs, errors lower/higher/equal."""
    joined = a.alias("a").join(b.alias("b"), key)
    def same(cols):
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return cond
    before, after = F.col(f"a.{error}"), F.col(f"b.{error}")
    return joined.agg(
        F.count(F.lit(1)).alias("shared"), F.count_if(same(inputs)).alias("same_inputs"), F.count_if(~same(outputs)).alias("changed"),
        F.count_if(after < before).alias("lower"), F.count_if(after > before).alias("higher"), F.count_if(after == before).alias("equal"))


def pair_branches(low: DataFrame, high: DataFrame, key: str) -> DataFrame:
    """Members of both branches; a member missing on either side fails the job."""
    both = low.withColumn("_l", F.lit(1)).join(high.withColumn("_h", F.lit(1)), key, "full")
    return require(both, F.col("_l").isNotNull() & F.col("_h").isNotNull(), "branches have different members").drop("_l", "_h")


def expand_grid(photos: DataFrame, grid: list[tuple[float, float]], names: tuple[str, str] = ("exposure", "recovery")) -> DataFrame:
    """Every photo with every variant of a fixed grid (a generated array, not a join)."""
    points = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(float(a)).alias(names[0]), F.lit(float(b)).alias(names[1])) for i, (a, b) in enumerate(grid)])
    return photos.select("*", F.explode(points).alias("_g")).select(*photos.columns, "_g.*")


def best_variant(scores: DataFrame, keys: list[str], error: str, order: str = "variant") -> DataFrame:
    """Smallest error per photo, first variant on a tie."""
    pick = F.struct(error, order)
    return scores.groupBy(*keys).agg(F.min(pick).alias("_b")).select(*keys, F.col(f"_b.{order}").alias(order), F.col(f"_b.{error}").alias(error))


def best_epoch(history: DataFrame, patience: int, min_delta: float = 0.0, run: str = "run", bins: int = 64) -> DataFrame:
    """Best epoch per run under a patience stop over a recorded history.

    With a margin, an epoch counts as an improvement when it beats every earlier value by more than it.
    Long runs are cut into blocks of epochs; a block starts from the minimum of the blocks before it.
    """
    block = F.floor((F.col("epoch") - 1) / bins)
    rows = history.withColumn("_block", block)
    minima = rows.groupBy(run, "_block").agg(F.min("val").alias("_low"))
    earlier = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = minima.select(run, "_block", F.min("_low").over(earlier).alias("_start"))
    inside = Window.partitionBy(run, "_block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.join(starts, [run, "_block"]).withColumn("_before", F.least("_start", F.min("val").over(inside)))
    better = F.col("_before").isNull() | (F.col("val") < F.col("_before") - min_delta)
    improved = marked.where(better).select(run, "epoch", "val")
    following = Window.partitionBy(run).orderBy("epoch")
    last = history.groupBy(run).agg(F.max("epoch").alias("_last"))
    gaps = improved.withColumn("_next", F.lead("epoch").over(following)).join(last, run)
    # the run stops at the first improvement that is not followed by another within ``patience`` epochs
    stops = gaps.where(F.coalesce(F.col("_next") - F.col("epoch") > patience, F.lit(True)))
    return stops.groupBy(run).agg(F.min(F.struct("epoch", "val", "_last")).alias("_s")).select(
        run, F.col("_s.epoch").alias("best_epoch"), F.col("_s.val").alias("best_val"),
        F.least(F.col("_s.epoch") + patience, F.col("_s._last")).alias("epochs_run"))


def effect_summary(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Better / worse / equal counts with extremes and means of the change."""
    change = F.col(after) - F.col(before)
    return df.agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(change < 0).alias("lower"), F.count_if(change > 0).alias("higher"), F.count_if(change == 0).alias("equal"),
        F.min(change).alias("min_change"), F.max(change).alias("max_change"), F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"))


def reason_counts(df: DataFrame, reasons: list[str], col: str = "reasons") -> DataFrame:
    """Counts of declared reasons with zero fill."""
    spark = df.sparkSession
    declared = spark.createDataFrame([(r,) for r in reasons], "reason string")
    counted = df.select(F.explode(col).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return declared.join(counted, "reason", "left").select("reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two attributes with subtotals and total."""
    return df.rollup(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def mean_metrics(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Averages that skip unknown values."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def label_match(pred: DataFrame, expected: DataFrame, key: str = "photo") -> DataFrame:
    """Whether the predicted label is among the declared acceptable ones."""
    return pred.join(expected, key).withColumn("match", F.array_contains("accepted", F.col("label")))


def latency_summary(samples: DataFrame, config: str, value: str) -> DataFrame:
    """Exact p50 and p95 per configuration."""
    q = exact_percentiles(samples, [config], value, [0.5, 0.95])
    return q.groupBy(config).agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95"))


def repeat_difference(rows: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """Largest difference between repeated passes of the same item."""
    spread = rows.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return spread.agg(F.max("_d").alias("max_difference"), F.min("_n").alias("min_runs"), F.max("_n").alias("max_runs"))
