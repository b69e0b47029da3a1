"""Tables written to the shared checkpoint folder, and helpers that keep hot keys apart."""

from __future__ import annotations

import copy
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from photospark.session import ensure_checkpoint_dir

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Intermediate tables of one run under the folder that ``spark.checkpoint.dir`` names.

    A written table survives the loss of executors, cuts the lineage and has exact sizes for the optimizer.
    ``drop`` removes tables that no later step reads; what the returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path, kept = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # else shuffle files of steps that are done stay until the driver collects its garbage
        try:
            df.write.parquet(path, compression=codec)
        finally:
            self.spark.conf.unset(CLEANUP) if kept is None else self.spark.conf.set(CLEANUP, kept)
        self.spark._jvm.System.gc()  # plans and bitmaps of steps that are done would fill the driver's heap up to its limit
        return self.spark.read.schema(df.schema).parquet(path)

    def write_measured(self, df: DataFrame, name: str, codec: str | None = None, **measures: Column) -> tuple[DataFrame, dict]:
        """``write`` and the given aggregates of the written rows, in one job."""
        seen = Observation()
        return self.write(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name, codec), seen.get

    def inner(self, name: str) -> Stage:
        """A stage below this one, for tables that go together with ``clear``."""
        own = copy.copy(self)
        own.root = f"{self.root}/{name}-{uuid.uuid4().hex}"
        return own

    def clear(self) -> None:
        """Remove all tables; nothing may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def maybe_in(ids: DataFrame, key: str, probe: Column, bits: int = 24) -> Column:
    """True for every value of ``ids[key]`` and for few others: a bitmap of ``2**bits`` hash bits.

    Whatever the size of ``ids``, the bitmap has at most ``2**bits / 64`` words (2 MB), made by ``bit_or`` per
    word. It only spares a shuffle; an exact join has to follow. Null is never in it.
    """
    spark = ids.sparkSession
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    words = ids.where(F.col(key).isNotNull()).select(spot.alias("_b")).groupBy(F.shiftright("_b", 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("v")).toArrow()
    full = np.zeros(1 << (bits - 6), np.int64)
    full[words["w"].to_numpy()] = words["v"].to_numpy()
    bitmap = spark.createDataFrame(pa.table({"m": pa.array([full], pa.list_(pa.int64()))})).scalar()
    at = F.pmod(F.xxhash64(probe), F.lit(1 << bits))
    bit = F.call_function("getbit", F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int"))
    return probe.isNotNull() & (bit == 1)


def with_group_min(df: DataFrame, keys: list[str], value: str, name: str, salts: int = 32) -> DataFrame:
    """Add the least ``value`` of each key group to its rows, without bringing a group together.

    Groups are cut by a hash of ``value``: the least of each piece, then of the pieces, then back to the pieces.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    low = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("_m")).groupBy(*keys).agg(
        F.min("_m").alias(name), F.collect_list("_salt").alias("_salts"))
    back = low.select(*keys, name, F.explode("_salts").alias("_salt"))
    return salted.join(back, [*keys, "_salt"]).drop("_salt")
