"""Connected components of links between 64-bit nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm.stage import Stage, with_group_min

#: So many links (16 MB) are followed by one task; only more of them take rounds of joins.
FEW = 1 << 20


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (u, v), for every node with an edge.

    Alternating steps hang each node's neighbours on the least of them until nothing changes. A hub's links are
    cut by hash (``with_group_min``), every round is written to the shared folder, and the rounds end by the
    state of the links alone. At most FEW links take no rounds.
    """
    star, before = _written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), stage, f"{name}0")
    if before["n"] <= FEW:
        out = stage.write(star.coalesce(1).mapInArrow(_followed, "node long, root long"), f"{name}1")
        stage.drop(f"{name}0")
        return out
    turn = 0
    while before["n"]:
        turn += 1
        star, after = _written(_inward(_outward(star)), stage, f"{name}{turn}")
        stage.drop(f"{name}{turn - 1}")
        if after == before:
            break
        before = after
    roots = star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _followed(batches):
    """Links (u, v) as (node, root): the larger of two roots hangs on the smaller until all links have one root."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
    u, v = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[:len(u)], at[len(u):], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _outward(star: DataFrame) -> DataFrame:
    """Larger neighbours go to the least of the node and its neighbours."""
    both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_group_min(both, ["u"], "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _inward(star: DataFrame) -> DataFrame:
    """Smaller neighbours and the node itself go to the least neighbour."""
    low = with_group_min(star, ["u"], "v", "m")
    return low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("v = m").select("u", "v")).distinct()


def _written(star: DataFrame, stage: Stage, name: str) -> tuple[DataFrame, dict]:
    """The links written, with their number and sums that tell one set of links from another."""
    return stage.write_measured(star, name, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), s=F.sum(F.col("v").cast("decimal(38,0)")))
