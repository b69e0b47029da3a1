"""Incremental ingest, upload de-duplication and burst sessions as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType


def file_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Newly arrived parquet files as a stream with a declared schema."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch feature job on each new batch; a replayed batch rewrites only its own folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        compute(batch).withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume_status(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """One row per identity of a batch: one of its rows, ``copies`` (rows of it in the batch) and ``status``, by the rule of ``lineage.incremental``.

    ``keys`` name what has to match for a result to be reused: id, configuration, source signature and content hash. An identity
    that ``seen`` lists is ``cached``, any other ``processed``. Keys may be null (null equals null).
    """
    once = batch.groupBy(*keys).agg(F.first(F.struct(*[c for c in batch.columns if c not in keys] or keys)).alias("_row"), F.count(F.lit(1)).alias("copies"))
    known = seen.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.lit(True).alias("_known"))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    status = F.when(F.col("_known"), "cached").otherwise("processed").alias("status")
    return once.join(known, same, "left").select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in batch.columns], status, "copies")


def ingest_new(stream: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Compute only what ``resume_status`` calls processed; ``out/results`` has each identity once, ``out/log`` a line per identity and batch.

    What is known are the identities that earlier batches list as processed in the log, one line each, so the state lies
    beside the results and is joined by key. A batch that is run again after a failure reads only batches before it and rewrites its own two folders.
    """
    spark = stream.sparkSession
    identity = stream.select(*keys).schema
    line = StructType([*identity.fields, StructField("copies", LongType()), StructField("epoch", LongType()), StructField("status", StringType())])
    # an empty first entry, so that the log can always be read
    spark.createDataFrame([], StructType([*identity.fields, line["copies"], line["status"]])).write.mode("ignore").partitionBy("status").parquet(f"{out}/log/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        seen = batch.sparkSession.read.schema(line).parquet(f"{out}/log").where((F.col("epoch") < epoch) & (F.col("status") == "processed"))
        kept = resume_status(batch, seen, keys).persist()  # read twice; a lost copy is computed again from the same log
        compute(kept.where("status = 'processed'").drop("status", "copies")).write.mode("overwrite").parquet(f"{out}/results/epoch={epoch}")
        kept.select(*keys, "copies", "status").write.mode("overwrite").partitionBy("status").parquet(f"{out}/log/epoch={epoch}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_upload(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First arrival of each upload identity; state is dropped once the watermark passes."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def burst_sessions(stream: DataFrame, keys: list[str], event_time: str, gap: str, delay: str) -> DataFrame:
    """Sessions per camera: captures chain while the gap to the next is at most ``gap``; late rows are dropped."""
    session = F.session_window(event_time, gap)
    return stream.withWatermark(event_time, delay).groupBy(*keys, session).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet until the available input is used up."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
