"""Table sources with explicit schemas and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.contract import FEATURES_SCHEMA, bound, finite, require
from photospark.functions.arrays import all_finite
from photospark.session import one_row

# Catalog tables and the columns each job may read.
CATALOG_SCHEMAS = {
    "collection": "id long, name string",
    "collection_image": "collection long, image long",
    "image": "id long, root_file long, capture_time string",
    "file": "id long, filename string",
    "develop": "id long, image long, history_id long, text string",
    "history": "id long, image long, name string, recorded string, text string",
    "exif": "image long, camera_ref long, serial long",
    "camera": "id long, value string",
    "keyword": "id long, name string",
    "keyword_image": "image long, tag long",
}


def scan_catalog(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Read the catalog's tables from ``path/<table>`` with fixed schemas; columns are pruned by use."""
    names = tables or list(CATALOG_SCHEMAS)
    return {n: spark.read.schema(CATALOG_SCHEMAS[n]).parquet(f"{path.rstrip('/')}/{n}") for n in names}


def scan_catalog_jdbc(spark: SparkSession, url: str, tables: dict[str, str], ranges: dict[str, tuple[str, int, int, int]] | None = None, **options: str) -> dict[str, DataFrame]:
    """The same tables through JDBC where a driver is on the class path; filters and columns push down.

    ``ranges`` gives, for large tables, (numeric column, least, largest, parts), so that they are read in parallel;
    other tables are read by one task. Not exercised here: it needs a database server.
    """
    out = {}
    for name, table in tables.items():
        column, low, high, parts = (ranges or {}).get(name, (None, 0, 0, 0))
        split = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if column else {}
        out[name] = spark.read.format("jdbc").options(url=url, dbtable=table, **split, **options).load()
    return out


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature bundle with its declared schema and per-row contract enforced."""
    return check_features(spark.read.schema(FEATURES_SCHEMA).parquet(path))


def feature_contract(width: int, targets: int = 6) -> Column:
    """Row rule of a feature bundle: widths, finite values and non-negative deviations."""
    return (
        F.col("photo_id").isNotNull()
        & (F.size("x") == width) & (F.size("y") == targets) & (F.size("y_std") == targets)
        & all_finite(F.col("x")) & all_finite(F.col("y")) & all_finite(F.col("y_std"))
        & F.forall("y_std", lambda v: v >= 0)
    )


def check_features(df: DataFrame, width: int = 132) -> DataFrame:
    """Refuse the bundle when any row breaks the contract (identifiers: see ``duplicate_ids``)."""
    return require(df, feature_contract(width), "feature bundle breaks its contract")


def duplicate_ids(df: DataFrame, key: str = "photo_id") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_manifest(features: DataFrame, manifest: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Pass features through only under a complete, matching manifest and without unsupported ids.

    ``manifest`` is one row (status, scope, config_hash); the leak test is a semi join reduced to one count.
    """
    leaks = features.join(unsupported.select("photo_id").distinct(), "photo_id", "left_semi")
    leaked = leaks.agg(F.count(F.lit(1)).alias("n")).scalar()
    head = one_row(manifest.select("status", "scope", "config_hash"))
    gated = features.withColumn("_m", head).withColumn("_leaked", leaked)
    ok = (
        (F.col("_m.status") == "complete")
        & F.col("_m.scope").isin("pilot", "full")
        & (F.length("_m.config_hash") > 0)
        & (F.col("config_hash") == F.col("_m.config_hash"))
        & (F.col("_leaked") == 0)
    )
    return require(gated, ok, "features do not match a complete manifest").drop("_m", "_leaked")


def scrape_listing(pages: DataFrame, row_re: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """Rows of an HTML listing: one record per block, one column per capture pattern."""
    blocks = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(row_re), F.lit(0))).alias("pos", "block"))
    return blocks.select(
        *[c for c in pages.columns if c != html], "pos",
        *[F.regexp_extract("block", pattern, 1).alias(name) for name, pattern in fields.items()],
    )


def in_bounds(parameter: str, value: Column) -> Column:
    """Inclusive contract range of a named parameter."""
    return finite(value) & value.between(bound(parameter, "lo"), bound(parameter, "hi"))
