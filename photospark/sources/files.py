"""File sources: photo folders, label JSON, archives, records and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photospark.contract import require

LABELS_SCHEMA = "photo_id string, experts map<string, map<string, double>>"
# Columns of the experiment ledger.
LEDGER_COLUMNS = (
    "run_id string, status string, seed int, split_seed int, train_count long, validation_count long, test_metrics_computed boolean, "
    "dual_p2 double, dual_exposure_mae_ev double, dual_recovery_mae double, wall_seconds double, peak_rss_bytes long, "
    "config_sha256 string, evaluation_sha256 string"
)


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, bytes, modified): directory listing without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def scan_photos(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".dng",)) -> DataFrame:
    """Photo files by case-blind suffix with lower-cased ids; id collisions and an empty folder fail the job."""
    globs = "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    files = list_files(spark, path, globs).withColumn("photo_id", F.lower("name"))
    counted = files.groupBy("photo_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("path", "bytes", "modified")).alias("_f"))
    unique = require(counted, F.col("_n") == 1, "case-insensitive file name collision").select("photo_id", "_f.*")
    return unique


def require_inputs(df: DataFrame) -> DataFrame:
    """Fail when there is nothing to process (one bounded look at the input)."""
    if df.isEmpty():
        raise ValueError("no inputs")
    return df


def source_signature(files: DataFrame) -> DataFrame:
    """(photo_id, signature): size and modification time, to detect a changed source."""
    return files.select("photo_id", F.concat_ws(":", F.col("bytes").cast("string"), F.unix_micros("modified").cast("string")).alias("signature"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Nested label records (one JSON object per photo and line) to long rows (photo_id, expert, parameter, value)."""
    raw = spark.read.schema(LABELS_SCHEMA).json(path)
    return raw.select("photo_id", F.explode("experts").alias("expert", "_p")).select("photo_id", "expert", F.explode("_p").alias("parameter", "value"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of one-record JSON files as a table with a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER_COLUMNS) -> DataFrame:
    """CSV ledger; a blank cell means not measured."""
    return spark.read.option("header", "true").option("nullValue", "").option("mode", "FAILFAST").schema(schema).csv(path)


def scan_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """Members of every archive under a folder; see ``archive_members``."""
    return archive_members(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, member, branch, bytes, sha256) of every member of (path, content) rows; a repeated member path fails the job."""
    def members(batches):
        import hashlib
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(name, i.filename, i.filename.split("/")[0], i.file_size, hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["archive", "member", "branch", "bytes", "sha256"])

    listed = files.mapInPandas(members, "archive string, member string, branch string, bytes long, sha256 string")
    counted = listed.groupBy("archive", "member").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in ("branch", "bytes", "sha256")])
    return require(counted, F.col("_n") == 1, "duplicate path inside an archive").drop("_n")
