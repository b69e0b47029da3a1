"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.session import cut_lineage


def connected_components(ids: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, group): every id with the smallest id reachable over the edges; isolated ids keep their own.

    Each step finds a minimum per node and brings it back to the node's edges. A node's edges are cut by hash of
    the other end, so those of a hub lie in many tasks. Rounds are written to the checkpoint folder; the edge set's
    size and hash sum decide when it has stopped changing, and nothing else ends the rounds.
    """
    star = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    star = cut_lineage(star)
    before = _state(star)
    while before[0]:
        star = cut_lineage(_small_star(_large_star(star)))
        after = _state(star)
        if after == before:
            break
        before = after
    roots = star.select(F.col("u").alias(key), F.col("v").alias("_root"))
    return ids.select(key).join(roots, key, "left").select(key, F.coalesce("_root", key).alias("group"))


def with_least(edges: DataFrame, salts: int = 32) -> DataFrame:
    """Add ``m``, the least ``v`` of each ``u``: of pieces cut by a hash of ``v`` first, then of the pieces, then back."""
    pieces = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
    low = pieces.groupBy("u", "_salt").agg(F.min("v").alias("_m")).groupBy("u").agg(F.min("_m").alias("m"), F.collect_list("_salt").alias("_salts"))
    return pieces.join(low.select("u", "m", F.explode("_salts").alias("_salt")), ["u", "_salt"]).drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = with_least(edges)
    moved = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.where("v = m").select("u", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
