"""Persisted split: reuse when its header matches, refuse otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from photospark.operators.lineage import fingerprint
from photospark.operators.splits import check_partition, group_split, leak_check
from photospark.sources.sinks import write_new


def load_or_create_split(spark: SparkSession, photos: DataFrame, path: str, data_version: str, seed: int = 42, scope: str = "full") -> DataFrame:
    """(photo_id, group_id, split) stored under ``path`` with a one-row header; any header change is refused."""
    if not data_version:
        raise ValueError("a data version is required")
    groups = fingerprint(photos, ["photo_id", "group_id"]).first()
    header = {"schema_version": "1", "scope": scope, "seed": str(seed), "ratios": "8:1:1", "data_version": data_version, "groups": groups["fingerprint"]}
    wanted = spark.createDataFrame([tuple(header.values())], ", ".join(f"{k} string" for k in header))
    try:
        saved = spark.read.schema(wanted.schema).parquet(f"{path}/header").first().asDict()
    except AnalysisException:
        # the header is written last, so a folder without it is an unfinished run and is refused by the first write
        write_new(group_split(photos, seed=seed), f"{path}/splits")
        write_new(wanted, f"{path}/header")
        saved = header
    if saved != header:
        raise ValueError("existing split is stale or uses another configuration")
    splits = spark.read.parquet(f"{path}/splits")
    bad = {**check_partition(splits, photos).first().asDict(), **leak_check(splits, photos, photos.limit(0)).first().asDict()}
    if any(bad.values()):
        raise ValueError(f"saved split does not partition the photos: {bad}")
    return splits
