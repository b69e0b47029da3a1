"""Failure triage and measured-alignment status rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.contract import require


def finalize_support(inputs: DataFrame, failures: DataFrame, headers: DataFrame, allowed: str, key: str = "photo_id") -> DataFrame:
    """(id, status) once failures are triaged.

    Only the one allowed reason may become "unsupported"; any other reason fails the job, and so does a
    failed input whose header shows that it is supported after all.
    """
    reclaimed = headers.select(key, F.lit(True).alias("_ok")).distinct()
    judged = failures.join(reclaimed, key, "left")
    safe = require(judged, F.col("error") == allowed, "a failure has another reason than the allowed one")
    safe = require(safe, F.col("_ok").isNull(), "a failed input has a supported header")
    return inputs.join(safe.select(key, F.lit("unsupported").alias("status")), key, "left").withColumn(
        "status", F.coalesce("status", F.lit("success")))


def bound_inputs(files: DataFrame, max_bytes: int, max_pixels: int, suffixes: list[str]) -> DataFrame:
    """Reasons why an input file is refused: suffix, byte size, pixel count (columns name, bytes, height, width)."""
    name = F.lower(F.col("name"))
    known = F.regexp_extract(name, r"(\.[^.]*)$", 1).isin(*suffixes)
    pixels = F.col("height").cast("long") * F.col("width").cast("long")
    return files.withColumn("reasons", F.array_compact(F.array(
        F.when(~known, "unsupported suffix"),
        F.when((F.col("bytes") < 1) | (F.col("bytes") > max_bytes), "file size out of bounds"),
        F.when((pixels < 1) | (pixels > max_pixels), "pixel count out of bounds"),
    )))


def alignment_status(df: DataFrame) -> DataFrame:
    """quarantine / uncertain / pass from a measured shift (dx, dy) and its response."""
    shift = F.greatest(F.abs("dx"), F.abs("dy"))
    return df.withColumn("alignment", F.when((F.col("response") >= 0.2) & (shift > 2), "quarantine").when(F.col("response") < 0.2, "uncertain").otherwise("pass"))


def geometry_status(matches: DataFrame, key: str = "photo") -> DataFrame:
    """Status per photo from its matched points (inlier, error) and repeated aspect and corner measures.

    Points per photo are bounded by the detector, so the per-photo percentile state is too.
    """
    g = matches.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.count_if("inlier").alias("inliers"), F.max("aspect_difference").alias("aspect_difference"),
        F.max("corner_shift").alias("corner_shift"), F.percentile(F.when(F.col("inlier"), F.col("error")), 0.5).alias("median_error"))
    few = (F.col("inliers") < 25) | (F.col("inliers") < F.col("points") * 0.4)
    return g.withColumn("geometry", F.when(F.col("aspect_difference") > 0.005, "quarantine_aspect").when(few, "quarantine_matches")
                        .when((F.col("corner_shift") > 3) | (F.col("median_error") > 2), "quarantine_shift").otherwise("pass"))
