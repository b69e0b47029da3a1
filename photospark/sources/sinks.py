"""Sinks: committed, exclusive, content-addressed, append-only and ordered writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from photospark.operators.lineage import fingerprint


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All-or-nothing replacement: written beside the old data, which is only moved away once the new is complete.

    A failed job leaves the old data in place. Two renames make the switch; if it breaks off between them, the old data
    lies complete in the sibling ``<path>.old-*``.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    place = spark._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = place(path), place(f"{path.rstrip('/')}.new-{mark}"), place(f"{path.rstrip('/')}.old-{mark}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.mode("errorifexists").format(fmt).save(fresh.toString())
    except Exception:
        files.delete(fresh, True)
        raise
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"cannot move the old data of {path}")
    if not files.rename(fresh, target):
        files.rename(old, target)
        raise OSError(f"cannot put the new data at {path}")
    files.delete(old, True)


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Exclusive creation: an existing run is never replaced."""
    df.write.mode("errorifexists").format(fmt).save(path)


def snapshot(df: DataFrame, root: str) -> str:
    """Content-addressed copy: the same content is written once, another content gets another path."""
    digest = fingerprint(df, sorted(df.columns)).first()["fingerprint"]
    path = f"{root.rstrip('/')}/snapshot.{digest}"
    try:
        write_new(df, path)
    except AnalysisException:
        held = fingerprint(df.sparkSession.read.parquet(path), sorted(df.columns)).first()["fingerprint"]
        if held != digest:
            raise ValueError("existing snapshot does not match its name") from None
    return path


def write_failures(df: DataFrame, path: str) -> None:
    """Append dead letters; nothing already logged is touched."""
    df.write.mode("append").json(path)


def write_residuals(df: DataFrame, path: str, order: list) -> None:
    """Range-sorted residual CSV with a header; part files follow the sort order."""
    df.orderBy(*order).write.mode("errorifexists").option("header", "true").csv(path)


def open_test(df: DataFrame, path: str) -> None:
    """One-time access record of a test partition; a second access is refused."""
    write_new(df.select("run", F.current_timestamp().alias("opened")), path, "json")
