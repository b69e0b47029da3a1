"""Incremental runs, fingerprints, run status, frozen manifests and comparability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photospark.contract import require


def row_digest(cols: list[str]):
    """SHA-256 of a row's text form; nulls differ from empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row (rows, fingerprint) over the multiset of rows.

    The eight 32-bit words of every row digest are summed, so the digest combines map-side and no task sees
    all rows; any added, removed or changed row changes the sums.
    """
    words = [F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = df.select(row_digest(cols).alias("_d")).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("rows", F.sha2(F.concat_ws(",", *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(8)]), 256).alias("fingerprint"))


def content_duplicates(files: DataFrame, content: str, key: str) -> DataFrame:
    """Content hashes shared by several items, with the first id and the number of copies."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def run_accounting(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: inputs = success + filtered + failed, cached counted inside success, overall status."""
    n = inputs.agg(F.count(F.lit(1)).alias("n")).scalar()
    c = results.agg(
        F.count_if(F.col("status").isin("processed", "cached")).alias("success_count"), F.count_if(F.col("status") == "filtered").alias("filtered_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"), F.count_if(F.col("status") == "cached").alias("cached_count")).withColumn("input_count", n)
    checked = require(c, F.col("input_count") == F.col("success_count") + F.col("filtered_count") + F.col("failed_count"), "run does not account for every input")
    return checked.withColumn("status", F.when((F.col("success_count") > 0) & (F.col("failed_count") == 0), "complete").otherwise("failed"))


def incremental(inputs: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Reuse a cached row only when id, configuration, source signature and content hash all match; compute the rest."""
    reused = cache.join(inputs.select(*keys), keys, "left_semi").withColumn("status", F.lit("cached"))
    todo = inputs.join(cache.select(*keys), keys, "left_anti")
    return reused.unionByName(compute(todo).withColumn("status", F.lit("processed")))


def guard_config(config: str, prior: str | None, rebuild: bool = False, scope: str = "full", prior_scope: str | None = None) -> None:
    """Refuse a changed configuration unless rebuilding, and a pilot on top of a full run."""
    if scope == "pilot" and prior_scope == "full":
        raise ValueError("a pilot cannot replace a full run")
    if prior is not None and prior != config and not rebuild:
        raise ValueError("configuration changed: rebuild or use another output")


def run_status(spark: SparkSession, path: str, run: str, status: str, reason: str = "") -> None:
    """Append one status record of a run (running, complete or failed)."""
    row = spark.range(1).select(F.lit(run).alias("run"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(path)


def latest_status(log: DataFrame) -> DataFrame:
    """Last record of each run."""
    return log.groupBy("run").agg(F.max_by("status", "at").alias("status"), F.max_by("reason", "at").alias("reason"))


def freeze(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))


def verify(current: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Items whose hash changed, that disappeared, or that were not in the manifest."""
    j = manifest.select(key, F.col("sha256").alias("_m")).join(current.select(key, F.col("sha256").alias("_c")), key, "full")
    problem = F.when(F.col("_c").isNull(), "missing").when(F.col("_m").isNull(), "unexpected").when(F.col("_c") != F.col("_m"), "changed")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def verify_protected(before: DataFrame, after: DataFrame, approved: DataFrame, key: str = "path") -> DataFrame:
    """Changed protected items outside the approved list (empty when all is well)."""
    return verify(after, before, key).join(approved.select(key), key, "left_anti")


def same_config(a: DataFrame, b: DataFrame, key: str, ignore: list[str]) -> DataFrame:
    """Whether two runs' settings maps are equal once the named keys are left out."""
    def rest(m):
        return F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*ignore))))

    j = a.select(key, F.col("config").alias("_a")).join(b.select(key, F.col("config").alias("_b")), key)
    return j.select(key, rest(F.col("_a")).eqNullSafe(rest(F.col("_b"))).alias("comparable"))


def hash_chain(stages: DataFrame, key: str) -> DataFrame:
    """Breaks in a chain of stages (order, input_sha, output_sha): an input that is not the previous output."""
    before = F.lag("output_sha").over(Window.partitionBy(key).orderBy("stage"))
    return stages.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col("_b") != F.col("input_sha"))).select(key, "stage")
