"""Paired bootstrap and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.functions.text import md5_pick
from photospark.operators.quantiles import global_rank


def group_sums(errors: DataFrame, group: str = "group_id") -> DataFrame:
    """Photo-weighted sums of control and candidate error per group, numbered 0..G-1 by group order."""
    return errors.groupBy(group).agg(F.sum("control").alias("control"), F.sum("candidate").alias("candidate"), F.count(F.lit(1)).alias("n"))


#: Groups that a bucket of the bootstrap holds; their sums travel as one array.
WIDTH = 4096


def bucket_draws(spark: SparkSession, groups: int, draws: int, seed: int, width: int = WIDTH) -> DataFrame:
    """(draw, bucket, picks): how many of the ``groups`` picks of each draw fall into each run of ``width`` groups.

    The first level of the resampling tree. Pick ``i`` has an MD5-derived position; a task makes the picks of a run of
    draws and counts them per bucket before anything is sent, so draws x buckets rows travel at most once per task.
    """
    place = F.pmod(md5_pick(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))), F.lit(groups))
    return spark.range(draws * groups).select(F.floor(F.col("id") / groups).alias("draw"), F.floor(place / width).alias("bucket")).groupBy("draw", "bucket").agg(
        F.count(F.lit(1)).alias("picks"))


def bucket_picks(seed: int, picks: Column, size: Column) -> Column:
    """Positions inside a bucket of ``size`` groups for the picks that fell into it: the second level of the tree."""
    toss = lambda j: md5_pick(F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.col("bucket").cast("string"), j.cast("string")))
    return F.transform(F.sequence(F.lit(1).cast("long"), picks), lambda j: F.pmod(toss(j), size).cast("int"))


def paired_bootstrap(errors: DataFrame, draws: int, seed: int, group: str = "group_id", width: int = WIDTH) -> DataFrame:
    """2.5/97.5 % interval of the relative improvement when whole groups are resampled.

    Each draw takes as many groups as there are, with replacement. Its picks go down a tree of two levels: they are
    counted per bucket of ``width`` groups, and a bucket, which holds the sums of its groups as one array, deals its own
    picks to them where the array is. So no row per draw and group is ever sent, and sums are combined map-side.
    """
    sums = global_rank(group_sums(errors, group), [F.col(group)], "position").withColumn("_at", F.col("position") - 1)
    total = sums.count()
    if total == 0:
        raise ValueError("no groups to resample")
    members = sums.groupBy(F.floor(F.col("_at") / width).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("_at", "control", "candidate"))).alias("_members"))
    # few bytes, much work: a number of tasks by size would leave all tosses of the second level to one
    spark = errors.sparkSession
    dealt = bucket_draws(spark, total, draws, seed, width).repartition(spark.sparkContext.defaultParallelism, "draw").join(members, "bucket")
    drawn = F.transform(bucket_picks(seed, F.col("picks"), F.size("_members")), lambda k: F.get("_members", k))
    zero = F.struct(F.lit(0.0).alias("control"), F.lit(0.0).alias("candidate"))
    added = F.aggregate(drawn, zero, lambda acc, m: F.struct((acc["control"] + m["control"]).alias("control"), (acc["candidate"] + m["candidate"]).alias("candidate")))
    scores = dealt.select("draw", added.alias("_s")).groupBy("draw").agg(F.sum("_s.control").alias("control"), F.sum("_s.candidate").alias("candidate"))
    # one value per draw: the percentile state is bounded by the number of draws
    gain = F.lit(1.0) - F.col("candidate") / F.col("control")
    return scores.agg(F.percentile(gain, F.array(F.lit(0.025), F.lit(0.975))).alias("_q")).select(
        F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def seed_summary(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and sample deviation over seeds."""
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("seeds"))


def pick_winner(runs: DataFrame, by: str, score: str) -> DataFrame:
    """Run with the smallest score, ties by name."""
    return runs.orderBy(score, by).limit(1)


def promotion_gates(runs: DataFrame, fields: DataFrame, interval: DataFrame) -> DataFrame:
    """Four research gates and the decision.

    ``runs``: (seed, control, candidate); ``fields``: (field, control, candidate) mean errors;
    ``interval``: one row (low, high).
    """
    worst_field = fields.agg(F.max(F.col("candidate") / F.col("control") - 1).alias("w")).scalar()
    low = interval.select("low").scalar()
    base = runs.agg(F.count_if(F.col("candidate") < F.col("control")).alias("_wins"), (F.lit(1.0) - F.avg("candidate") / F.avg("control")).alias("improvement"))
    gated = base.withColumns({"worst_field_change": worst_field, "interval_low": low}).select(
        "improvement", (F.col("_wins") >= 2).alias("improved_two_of_three"), (F.col("improvement") >= 0.05).alias("mean_improvement_at_least_5_percent"),
        (F.col("worst_field_change") <= 0.02).alias("delivered_fields_within_2_percent"), (F.col("interval_low") > 0).alias("positive_bootstrap_interval"))
    every = F.col("improved_two_of_three") & F.col("mean_improvement_at_least_5_percent") & F.col("delivered_fields_within_2_percent") & F.col("positive_bootstrap_interval")
    return gated.withColumn("decision", F.when(every, "eligible_for_further_acceptance").otherwise("retain_control"))


# Rule sets (gate, metric, comparison, baseline, factor, offset); baseline null = constant limit.
GATE_RULES = {
    "illumination": [
        ("psnr_plus_half_db", "psnr_db", ">=", "base", 1.0, 0.5),
        ("within_quarter_db_of_global", "psnr_db", ">=", "global", 1.0, -0.25),
        ("dark_variation_below_90pct", "dark_median_residual_codes", "<=", "base", 0.9, 0.0),
        ("chroma_not_worse", "chroma_mse", "<=", "base", 1.0, 0.0),
        ("gradient_within_110pct", "luma_gradient_l1", "<=", "base", 1.1, 0.0),
        ("new_full_channels_below_half_pct", "new_full_channel_fraction", "<=", None, 0.0, 0.005),
    ],
    "noise": [
        ("psnr_over_v3_by_half_db", "psnr_db", ">=", "experimental-v3", 1.0, 0.5),
        ("psnr_within_half_db_of_constant", "psnr_db", ">=", "constant", 1.0, -0.5),
        ("dark_residual_at_most_70pct_gamma_control", "dark_median_residual_codes", "<=", "gamma-control", 0.7, 0.0),
        ("chroma_mse_at_most_110pct_gamma_control", "chroma_mse", "<=", "gamma-control", 1.1, 0.0),
        ("new_full_channel_at_most_half_percent", "new_full_channel_fraction", "<=", None, 0.0, 0.005),
    ],
    "curve": [
        ("gain_over_constant_at_least_half_db", "psnr_db", ">=", "constant", 1.0, 0.5),
        ("gain_over_v3_at_least_half_db", "psnr_db", ">=", "experimental-v3", 1.0, 0.5),
        ("new_full_channels_at_most_half_percent", "new_full_channel_fraction", "<=", None, 0.0, 0.005),
    ],
}


def numeric_gates(summary: DataFrame, candidate: str, rules: list[tuple]) -> DataFrame:
    """Evaluate a rule table on rows (label, metric, value)."""
    table = summary.sparkSession.createDataFrame(rules, "gate string, metric string, op string, baseline string, factor double, offset double")
    mine = summary.where(F.col("label") == candidate).select("metric", F.col("value").alias("value"))
    base = summary.select(F.col("label").alias("baseline"), "metric", F.col("value").alias("_base"))
    joined = table.join(mine, "metric").join(base, ["baseline", "metric"], "left")
    limit = F.coalesce(F.col("_base") * F.col("factor"), F.lit(0.0)) + F.col("offset")
    known = F.col("baseline").isNull() | F.col("_base").isNotNull()
    passed = F.when(F.col("op") == ">=", F.col("value") >= limit).otherwise(F.col("value") <= limit) & known
    return joined.select("gate", "value", limit.alias("limit"), passed.alias("passed"))


def seeds_beating(summary: DataFrame, seeds: list[str], baselines: list[str], metric: str = "psnr_db", need: int = 2) -> DataFrame:
    """How many seed runs beat every baseline on a metric, and whether that is enough.

    Seeds and baselines come from one aggregation of the same rows, so a value computed once never beats itself.
    """
    label = F.col("label")
    one = summary.where(F.col("metric") == metric).agg(
        F.max(F.when(label.isin(*baselines), F.col("value"))).alias("_best"), F.collect_list(F.when(label.isin(*seeds), F.col("value"))).alias("_seeds"))
    better = F.coalesce(F.size(F.filter("_seeds", lambda v: v > F.col("_best"))), F.lit(0)).cast("long")
    return one.select(better.alias("better")).withColumn("passed", F.col("better") >= need)

