"""Greedy selection by quotas, in rounds of whole runs of picks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photospark.operators.quantiles import global_rank
from photospark.operators.splits import seeded_hash
from photospark.session import cut_lineage


class Needs:
    """What is still wanted of each listed value; a class is a combination of listed values, any other value being 0."""

    def __init__(self, quotas: dict[str, dict]):
        self.values = [[(v, q) for v, q in own.items() if q > 0] for own in quotas.values()]
        self.have = [[0] * (len(own) + 1) for own in self.values]

    def number(self, attrs: list[str]) -> Column:
        """The class of a row as a BIGINT."""
        out = F.lit(0).cast("long")
        for name, own in zip(attrs, self.values):
            place = reduce(lambda rest, k: F.when(F.col(name).eqNullSafe(F.lit(own[k][0])), k + 1).otherwise(rest), range(len(own)), F.lit(0))
            out = out * (len(own) + 1) + place
        return out

    def places(self, number: int) -> list[int]:
        out = []
        for own in reversed(self.values):
            number, place = divmod(number, len(own) + 1)
            out.append(place)
        return out[::-1]

    def of(self, number: int) -> float:
        return float(sum(max(0, own[k - 1][1] - have[k]) / max(1, own[k - 1][1]) for own, have, k in zip(self.values, self.have, self.places(number)) if k))

    def add(self, number: int, many: int = 1) -> None:
        for have, k in zip(self.have, self.places(number)):
            have[k] += many


def quota_select(df: DataFrame, quotas: dict[str, dict], n: int, seed: int = 42, key: str = "photo_id", group: str = "group_id",
                 block: int = 4096, digits: int = 3) -> DataFrame:
    """The rows of up to ``n`` picks with ``pick_order``: one per group, always from the attribute combination furthest under quota.

    Need is summed over the attributes as the open share of their quota; equal needs are settled by the seeded hash.
    Values without a quota need nothing and count alike, so the quota table bounds the number of classes. Of each
    class only the head of its queue can be chosen next: counts per hash prefix give the prefixes that hold ``block``
    rows that are still free. One task replays the picks on these heads until a head is used up, which is a run of
    at least ``block`` picks, or until nothing is needed; the driver keeps the tallies of the listed values. What is
    left after the quotas are met is the plain hash order and is taken by a distributed rank, whatever ``n`` is.
    """
    attrs, state = list(quotas), Needs(quotas)
    queue = cut_lineage(
        df.select(F.col(key).alias("_id"), F.col(group).alias("_group"), state.number(attrs).alias("_class"), seeded_hash(key, seed).alias("_h"))
        .groupBy("_group", "_class").agg(F.min(F.struct("_h", "_id")).alias("_m")).select("_group", "_class", "_m.*"))
    prefix = F.substring("_h", 1, digits)
    earlier = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = queue.groupBy("_class", prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    sizes = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    parts: list[DataFrame] = []
    done = 0
    while done < n:
        wanted = [c for c in sizes if state.of(c) > 0]
        if not wanted:
            break
        heads = counts.where(F.col("_class").isin(wanted) & (F.col("_before") < block + done)).select("_class", "_prefix")
        free = _free(queue.withColumn("_prefix", prefix).join(heads, ["_class", "_prefix"], "left_semi"), parts)
        picked = cut_lineage(_replay(free.select("_group", "_class", "_h", "_id"), state, [c for c in wanted if sizes[c] <= block + done], done, n))
        tally = picked.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()
        if not tally:
            break
        for r in tally:
            state.add(r["_class"], r["n"])
        done += sum(r["n"] for r in tally)
        parts.append(picked)
    if done < n:
        rest = cut_lineage(_free(queue, parts).groupBy("_group").agg(F.min(F.struct("_h", "_id")).alias("_m")).select("_group", "_m.*"))
        upto = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        first = rest.groupBy(prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        near = rest.withColumn("_prefix", prefix).join(first.where(F.col("_before") < n - done).select("_prefix"), "_prefix", "left_semi")
        ranked = global_rank(near.select("_group", "_h", "_id"), [F.col("_h"), F.col("_id")], "_rank").where(F.col("_rank") <= n - done)
        parts.append(ranked.select("_group", F.lit(0).cast("long").alias("_class"), "_h", "_id", (F.col("_rank") - 1 + done).cast("int").alias("pick_order")))
    chosen = reduce(DataFrame.unionByName, parts) if parts else queue.limit(0).withColumn("pick_order", F.lit(0))
    return df.join(chosen.select(F.col("_id").alias(key), "pick_order"), key)


def _free(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Rows of groups that no pick belongs to."""
    for picked in parts:
        used = picked.select(F.col("_group").alias("_used"))
        rows = rows.join(used, rows["_group"].eqNullSafe(used["_used"]), "left_anti")
    return rows


def _replay(heads: DataFrame, state: Needs, whole: list[int], done: int, n: int) -> DataFrame:
    """The next picks from the heads of the queues; ``whole`` lists the classes whose head is all that is left of them."""
    schema = T.StructType([*heads.schema.fields, T.StructField("pick_order", T.IntegerType())])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "_id"], ignore_index=True)
        queues = {c: own.index.tolist() for c, own in rows.groupby("_class")}
        codes, hashes, classes = pd.factorize(rows["_group"], use_na_sentinel=False)[0], rows["_h"].tolist(), rows["_class"].tolist()
        at, used, chosen = dict.fromkeys(queues, 0), set(), []
        while done + len(chosen) < n:
            for c, own in queues.items():
                while at[c] < len(own) and codes[own[at[c]]] in used:
                    at[c] += 1
            if any(at[c] == len(own) and c not in whole and state.of(c) > 0 for c, own in queues.items()):
                break
            live = [c for c, own in queues.items() if at[c] < len(own) and state.of(c) > 0]
            if not live:
                break
            best = min(live, key=lambda c: (-state.of(c), hashes[queues[c][at[c]]], queues[c][at[c]]))
            row = queues[best][at[best]]
            chosen.append(row)
            used.add(codes[row])
            state.add(classes[row])
        out = rows.iloc[chosen].copy()
        out["pick_order"] = range(done, done + len(chosen))
        return out[schema.names]

    return heads.groupBy(F.lit("one").alias("_one")).applyInPandas(pick, schema)
