"""Session construction, durable lineage cuts and one-row lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark 4.1 takes a union of inputs hashed alike as hashed itself, leaves out the exchange behind it, and then loses rows' places where
#: the adaptive plan reads the inputs in different partitions: a set difference of equal tables gave all rows of one of them.
UNIONS = "spark.sql.unionOutputPartitioning"


def sound_unions(spark: SparkSession) -> None:
    """Have every union exchanged before it is grouped or joined, in sessions that this library didn't build too."""
    spark.conf.set(UNIONS, "false")


def build_session(app: str = "photospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling; cluster settings stay untouched."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(UNIONS, "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; only a local session may get its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to storage shared by all executors")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and continue from the written copy.

    A copy survives lost executors, is read by column, has exact sizes for the optimizer, and carries none of the
    constraints of the plan that made it, which grow from round to round in a loop.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame) -> Column:
    """A single-row DataFrame as a struct column (scalar subquery, so no join is planned)."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()
