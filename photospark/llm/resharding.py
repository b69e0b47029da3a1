"""Resharding by minimum-cost flow: old shard sizes and new capacities give the transfers that move the fewest bytes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.llm.stage import Stage


def transfers(rows: list[int], shards: int, marginal: list[float]) -> list[tuple[int, int, int]]:
    """Minimum-cost flow from old shards to new ones: (old, new, rows) with ``new`` counts at most one apart.

    ``rows`` are the counts of the old shards; old shard i is new shard i if there is one. Every new shard takes the
    lower count, and one row more where that is granted. A row that stays costs nothing; which rows of a shard
    go is decided by size, so a granted row spares ``marginal[i]`` bytes, those of the largest row that shard i would
    have to give up for it. Found by cheapest augmenting paths; the graph has old + new + 3 nodes, whatever the
    number of rows.
    """
    total, olds = sum(rows), len(rows)
    low, extra = divmod(total, shards)
    start, end, grant = olds + shards, olds + shards + 1, olds + shards + 2
    arcs: list[list] = []
    out: list[list[int]] = [[] for _ in range(olds + shards + 3)]

    def arc(a: int, b: int, room: int, cost: float) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])

    dear = max([1.0, *marginal]) * 2
    for i, n in enumerate(rows):
        arc(start, i, n, 0.0)
        for j in range(shards):
            if i == j:
                arc(i, olds + j, low, 0.0)
                arc(i, olds + j, 1, dear - marginal[i])
            arc(i, olds + j, n, dear)
    for j in range(shards):
        arc(olds + j, end, low, 0.0)
        arc(olds + j, grant, 1, 0.0)
    arc(grant, end, extra, 0.0)
    while True:
        far, via = [float("inf")] * len(out), [-1] * len(out)
        far[start], queue = 0.0, [start]
        while queue:
            again = []
            for a in queue:
                for k in out[a]:
                    b, room, cost = arcs[k]
                    if room and far[a] + cost < far[b] - 1e-9:
                        far[b], via[b] = far[a] + cost, k
                        again.append(b)
            queue = list(dict.fromkeys(again))
        if via[end] < 0:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        flow = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= flow
            arcs[k ^ 1][1] += flow
    moved: dict[tuple[int, int], int] = {}
    for i in range(olds):
        for k in out[i]:
            b = arcs[k][0]
            if not k % 2 and olds <= b < olds + shards and arcs[k ^ 1][1]:
                moved[i, b - olds] = moved.get((i, b - olds), 0) + arcs[k ^ 1][1]
    return [(i, j, n) for (i, j), n in sorted(moved.items())]


def spread_rank(df: DataFrame, group: str, order: list[str], name: str, stage: Stage) -> DataFrame:
    """0-based rank of the rows of each ``group`` by ``order``: ranks inside parts cut by quantiles of the first column.

    A group is never ordered in one task: values of ``order[0]`` that many rows share are cut by hash.
    """
    n = df.count()
    parts = max(16, n // 65_536)
    sizes = df.groupBy(group, order[0]).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(group).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    starts = stage.write(sizes.withColumn("_start", F.coalesce(F.sum("_n").over(line), F.lit(0))), f"{name}-starts")
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    pieces = cut.groupBy(group, order[0], "_part").agg(F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy(group, order[0]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = stage.write(pieces.withColumn("_in", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(starts, [group, order[0]]).select(
        group, order[0], "_part", (F.col("_start") + F.col("_in")).alias("_before")), f"{name}-places")
    own = Window.partitionBy(group, order[0], "_part").orderBy(*order[1:])
    return cut.withColumn("_row", F.row_number().over(own) - 1).join(places, [group, order[0], "_part"]).withColumn(
        name, (F.col("_before") + F.col("_row")).cast("long")).drop("_part", "_row", "_before")


def reshard(docs: DataFrame, old: Column, stage: Stage, shards: int = 24, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot, and ``key``, a column that tells rows apart, if named.

    ``old`` names a document's old shard (any value, null is one too); the names in order are old shards 0, 1, ...,
    and their number is that of a layout, so it goes to the driver (some thousands are fine). The new counts are at
    most one apart, and the bytes that change shards are the fewest: an old shard with too many rows gives up its
    smallest ones. Slots are gapless in each shard, by a hash of the id.

    Null and empty texts have size 8; null ids and repeated rows are placed like others; a new shard without an old one
    starts empty; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    own = [key] if key else []
    base = stage.write(docs.select("doc_id", *own, old.cast("string").alias("_old"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
                                   F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")), "base")
    names = [r["_old"] for r in base.select("_old").distinct().collect()]
    names = sorted(names, key=lambda x: (x is None, x or ""))
    table = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "_name string, old_shard int")
    known = base.join(F.broadcast(table), F.col("_old").eqNullSafe(F.col("_name"))).select("doc_id", "size", "text_crc32", "old_shard", *own)
    ranked = stage.write(spread_rank(known, "old_shard", ["size", "doc_id", "text_crc32", *own], "rank", stage), "ranked")
    rows = [0] * len(names)
    for r in ranked.groupBy("old_shard").agg(F.count(F.lit(1)).alias("n")).collect():
        rows[r["old_shard"]] = r["n"]
    low = sum(rows) // shards
    edge = {i: n - low - 1 for i, n in enumerate(rows[:shards]) if n > low}
    marginal = [0.0] * len(names)
    if edge:
        wanted = F.create_map(*[F.lit(x) for i, k in edge.items() for x in (i, k)])
        for r in ranked.where(F.col("rank") == wanted[F.col("old_shard")]).select("old_shard", "size").collect():
            marginal[r["old_shard"]] = float(r["size"])
    runs, at = [], [0] * len(names)
    for i, j, n in sorted(transfers(rows, shards, marginal), key=lambda t: (t[0], t[0] == t[1], t[1])):
        runs.append((i, at[i], at[i] + n, j))
        at[i] += n
    plan = spark.createDataFrame(runs, "_old long, _lo long, _hi long, shard int")
    placed = ranked.join(F.broadcast(plan), (F.col("old_shard") == F.col("_old")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi"))).drop("_old", "_lo", "_hi", "rank")
    placed = placed.withColumn("_spot", F.pmod(F.xxhash64("doc_id"), F.lit(1024)))
    return spread_rank(stage.write(placed, "placed"), "shard", ["_spot", "doc_id", "size", "text_crc32", *own], "slot", stage).drop("_spot")


def rewrite(docs: DataFrame, placed: DataFrame, folder: str, key: str = "doc_id") -> list[int]:
    """Write the affected shards (those that rows leave or reach) as Parquet under ``folder``/shard=N; returns their numbers.

    ``key`` tells the rows of ``docs`` apart: no nulls, no repeats. A shard that nothing leaves or reaches keeps its old files.
    """
    moved = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    touched = sorted(r["shard"] for r in moved.join(placed.select("shard").distinct(), "shard").collect())
    spots = placed.where(F.col("shard").isin(touched)).select(key, "old_shard", "shard", "slot")
    # texts are shuffled once, by the join; each of its tasks writes a file per shard
    docs.join(spots.hint("merge"), key).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return touched


def numbered(docs: DataFrame, stage: Stage) -> DataFrame:
    """``docs`` with ``row``, the file and the place in it of each row; only a table that isn't read from files is copied."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row")
    try:
        return docs.select("*", place)
    except AnalysisException:
        return stage.write(docs, "rows").select("*", place)


def reshard_files(docs: DataFrame, old: Column, stage: Stage, shards: int = 24) -> DataFrame:
    """``reshard``, and the affected shards written: size, text_crc32, shard and slot of their rows are read from the files.

    Rows are named by their place in their file, so null and repeated ids are written once each; a table that isn't
    read from files is written first. Rows of other shards are as placed.
    """
    rows = numbered(docs.select("doc_id", "text", old.cast("string").alias("source")), stage)
    placed = stage.write(reshard(rows, F.col("source"), stage, shards, "row"), "placement")
    stage.drop("base", "ranked", "rank-starts", "rank-places", "placed", "slot-starts", "slot-places")
    folder = f"{stage.root}/files"
    touched = rewrite(rows, placed, folder, "row")
    kind = docs.schema["doc_id"].dataType.simpleString()
    files = docs.sparkSession.read.schema(f"doc_id {kind}, text string, old_shard int, slot long, shard int").parquet(folder)
    text = F.coalesce("text", F.lit(""))
    again = files.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "old_shard", "shard", "slot")
    stayed = placed.where(~F.col("shard").isin(touched)).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")
    return again.unionByName(stayed)
