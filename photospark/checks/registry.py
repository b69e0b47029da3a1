"""Registry of checked queries: a Spark callable plus, where SQL can express it, a twin text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.checks.views import View, with_views


@dataclass(frozen=True)
class Check:
    """One registered query."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating-point column so that both engines compare equal.

    A nudge far below the last digit decides exact halves the same way whatever the order of summation was.
    """
    cols = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("double", "float"):
            col = (F.round(col.cast("double") + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)).alias(field.name)
        cols.append(col)
    return df.select(*cols)


def check(name: str, sql: str | None = None, views: str = "", doubles: str = "", digits: int = 6):
    """Register ``fn(view) -> DataFrame``; ``doubles`` lists the twin's columns to round."""
    text = None
    if sql is not None:
        body = sql.strip()
        if doubles:
            nudge = 10.0 ** -(digits + 3)
            fixed = ", ".join(f"(round(CAST({c} AS DOUBLE) + CAST({nudge!r} AS DOUBLE), {digits}) + 0.0) AS {c}" for c in doubles.split())
            body = f"SELECT * REPLACE ({fixed}) FROM (\n{body}\n)"
        text = with_views(body, views.split())

    def wrap(fn):
        if name in CHECKS:
            raise ValueError(f"duplicate check {name}")
        CHECKS[name] = Check(lambda spark, path: rounded(fn(View(spark, path)), digits), text)
        return fn

    return wrap
