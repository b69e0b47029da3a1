"""Shared contracts: parameter bounds, schemas and row expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The six parameters in order with their inclusive absolute bounds.
PARAMETERS = (
    ("Exposure", -4.0, 4.0),
    ("Contrast", -50.0, 100.0),
    ("Saturation", -100.0, 100.0),
    ("Temperature", 2000.0, 50000.0),
    ("Tint", -150.0, 150.0),
    ("HighlightRecovery", 0.0, 100.0),
)
# Expert names, scene label vocabularies and fine-tuning limits.
EXPERTS = ("A", "B", "C", "D", "E")
SUBJECTS = (
    "people", "natural_landscape", "indoor_room", "urban_architecture",
    "animal_pet", "food", "object_still_life", "document_graphic",
)
LIGHTING = (
    "daylight", "overcast", "sunset_sunrise", "night", "indoor_artificial",
    "indoor_natural", "underexposed_daylight",
)
FINE_TUNING_LIMITS = {"warmth": (-20, 20), "tint": (-20, 20), "vibrance": (-20, 20), "local_contrast": (0, 20)}

NAMES = tuple(name for name, _, _ in PARAMETERS)

FEATURES_SCHEMA = T.StructType([
    T.StructField("photo_id", T.StringType()),
    T.StructField("x", T.ArrayType(T.FloatType())),
    T.StructField("y", T.ArrayType(T.FloatType())),
    T.StructField("y_std", T.ArrayType(T.FloatType())),
    T.StructField("config_hash", T.StringType()),
])


def parameter_table(spark: SparkSession) -> DataFrame:
    """The contract as a six-row dimension (ord, parameter, lo, hi)."""
    rows = [(i, n, lo, hi) for i, (n, lo, hi) in enumerate(PARAMETERS)]
    return spark.createDataFrame(rows, "ord int, parameter string, lo double, hi double")


def bound(parameter: str, side: str) -> Column:
    """Lower (``lo``) or upper (``hi``) bound of the parameter named by a column."""
    at = 1 if side == "lo" else 2
    cases = " ".join(f"WHEN '{row[0]}' THEN {row[at]}D" for row in PARAMETERS)
    return F.expr(f"CASE {parameter} {cases} END")


def finite(value: Column) -> Column:
    """True for a present, non-NaN, non-infinite number."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks ``ok``; rows pass through unchanged."""
    failed = ~F.coalesce(ok, F.lit(False))
    return df.where(F.when(failed, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
