"""Whole-group splits, seeded draws and partition checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photospark.functions.text import md5_pick

SPLITS = ("train", "val", "test")


def seeded_hash(key: str, seed: int):
    """The MD5 text that orders every seeded choice."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def allocate(classes: list[tuple[int, int]], ratios: tuple[int, ...] = (8, 1, 1)) -> list[tuple[int, int, int, list[int]]]:
    """``allocate_runs`` of a list of (group size, number of groups), largest size first."""
    return list(allocate_runs(classes, sum(c for _, c in classes), sum(s * c for s, c in classes), ratios))


def allocate_runs(classes: Iterable[tuple[int, int]], total_groups: int, photos: int, ratios: tuple[int, ...] = (8, 1, 1)) -> Iterator[tuple[int, int, int, list[int]]]:
    """Runs (size, start, length, pattern) of the greedy whole-group allocation, one class after the other.

    Each group goes to the split with the largest remaining deficit; runs of equal-size groups repeat a short pattern, so
    the work here depends on the number of distinct sizes only and the state is one number per split. The last three
    groups are placed singly so that no split stays empty.
    """
    if total_groups < len(ratios):
        raise ValueError("at least three distinct groups are needed")
    scale = sum(ratios)
    deficit = [r * photos for r in ratios]
    taken = [0] * len(ratios)
    left = total_groups

    def largest() -> int:
        return max(range(len(ratios)), key=lambda i: (deficit[i], -i))

    for size, count in classes:
        step, start = size * scale, 0
        while start < count:
            bulk = min(count - start, left - len(ratios))
            if bulk <= 0:
                empty = [i for i, t in enumerate(taken) if t == 0]
                pattern, rounds = [empty[0] if len(empty) == left else largest()], 1
            else:
                pattern, rounds = _cycle(deficit, step, bulk)
            yield size, start, len(pattern) * rounds, pattern
            for i in pattern:
                deficit[i] -= step * rounds
                taken[i] += rounds
            start += len(pattern) * rounds
            left -= len(pattern) * rounds


def _cycle(deficit: list[int], step: int, room: int) -> tuple[list[int], int]:
    """Next picks that repeat unchanged, and how often they may repeat."""
    order = sorted(range(len(deficit)), key=lambda i: (-deficit[i], i))
    top = deficit[order[0]]
    active = [i for i in order if top - deficit[i] < step]
    resting = [deficit[i] for i in order if i not in active]
    rounds = room // len(active)
    if resting:
        # stop while every active deficit is still clearly above the resting ones
        low = min(deficit[i] for i in active)
        rounds = min(rounds, (low - max(resting) - 1) // step)
    if rounds >= 1:
        return active, rounds
    return [order[0]], 1


def group_split(photos: DataFrame, key: str = "photo_id", group: str = "group_id", ratios: tuple[int, ...] = (8, 1, 1),
                seed: int = 42, digits: int = 3) -> DataFrame:
    """(key, group, split): approximately 80/10/10 without dividing a group.

    Groups are ordered by (size desc, seeded hash). The position of a group inside its size class is the number
    of groups in earlier hash buckets plus its rank in its own bucket, so no window spans a whole class. The distinct sizes
    are walked as a stream by one task: D of them need at least D * D / 2 photos, so there are at most the square root of
    twice the photos (141,422 for 10^10). Fewer than three groups fail the job; an empty table gives an empty split.
    """
    sizes = photos.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumn("_hash", seeded_hash(group, seed))
    keyed = sizes.withColumn("_bucket", F.substring("_hash", 1, digits))
    per_bucket = keyed.groupBy("_size", "_bucket").agg(F.count(F.lit(1)).alias("_groups"))
    everything = Window.partitionBy()
    classes = per_bucket.groupBy("_size").agg(F.sum("_groups").alias("n")).select(
        "_size", "n", F.sum("n").over(everything).alias("groups"), F.sum(F.col("_size") * F.col("n")).over(everything).alias("photos")).sortWithinPartitions(F.desc("_size"))

    def walk(batches):
        import itertools

        import pyarrow as pa

        rows = ((r["_size"], r["n"], r["groups"], r["photos"]) for batch in batches for r in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        sizes = ((size, n) for size, n, _, _ in itertools.chain([first], rows))
        for size, start, length, pattern in allocate_runs(sizes, first[2], first[3], ratios):
            yield pa.RecordBatch.from_pylist([{"_size": size, "_from": start, "_to": start + length, "_pattern": [SPLITS[i] for i in pattern]}])

    plan = classes.mapInArrow(walk, "_size long, _from long, _to long, _pattern array<string>")
    earlier = Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_size", "_bucket", F.coalesce(F.sum("_groups").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_size", "_bucket").orderBy("_hash", group)
    placed = keyed.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["_size", "_bucket"]).withColumn("_pos", F.col("_before") + F.col("_rank") - 1)
    in_run = (F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to"))
    slot = F.pmod(F.col("_pos") - F.col("_from"), F.size("_pattern")).cast("int")
    assigned = placed.join(plan, "_size").where(in_run).select(group, F.get("_pattern", slot).alias("split"))
    return photos.select(key, group).join(assigned, group).select(key, group, "split")


def draw_validation(groups: DataFrame, seen: DataFrame, photos: int = 16, minimum: int = 8, seed: int = 42,
                    key: str = "photo_id", group: str = "group_id") -> DataFrame:
    """Seeded draw of whole groups without a previously seen member until ``photos`` photos are reached."""
    touched = groups.join(seen.select(key), key, "left_semi").select(group).distinct()
    sizes = groups.join(touched, group, "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    # every group holds at least one photo, so the first ``photos`` groups suffice
    head = sizes.withColumn("_h", seeded_hash(group, seed)).orderBy("_h", group).limit(photos)
    before = Window.orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)
    drawn = head.withColumn("_sum", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_sum") < photos)
    counted = drawn.agg(F.count(F.lit(1)).alias("c")).scalar()
    checked = drawn.where(F.when(counted < minimum, F.raise_error(F.lit("too few independent validation groups")).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(group, "n")


def group_report(groups: DataFrame, splits: DataFrame, key: str = "photo_id", group: str = "group_id") -> DataFrame:
    """Per split: photos, groups, largest group, and groups that also occur in another split."""
    per = groups.select(key, group).join(splits.select(key, "split"), key).groupBy("split", group).agg(F.count(F.lit(1)).alias("n"))
    spread = per.groupBy(group).agg(F.count(F.lit(1)).alias("_in"))
    return per.join(spread, group).groupBy("split").agg(
        F.sum("n").alias("photos"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"), F.count_if(F.col("_in") > 1).alias("shared"))


def with_split(df: DataFrame, splits: DataFrame, key: str = "photo_id") -> DataFrame:
    """Attach the split of each row."""
    return df.join(splits.select(key, "split"), key)


def exclude_reserved(photos: DataFrame, reserved: DataFrame, key: str = "photo_id", group: str = "group_id") -> DataFrame:
    """Photos of groups that no reserved photo belongs to."""
    taken = photos.join(reserved.select(key), key, "left_semi").select(group).distinct()
    return photos.join(taken, group, "left_anti")


# ---------------------------------------------------------------- set checks


def check_partition(splits: DataFrame, ids: DataFrame, key: str = "photo_id") -> DataFrame:
    """One row: ids missing from the splits, unknown ids, and ids placed more than once."""
    counted = splits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = counted.join(ids.select(key, F.lit(True).alias("_known")).distinct(), key, "full")
    return both.agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_known").isNull()).alias("unknown"),
                    F.count_if(F.col("_n") > 1).alias("repeated"))


def common_split(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, split) rows in both versions."""
    return a.intersect(b)


def id_changes(old: DataFrame, new: DataFrame, key: str = "photo_id") -> DataFrame:
    """Ids added or removed between two versions."""
    return (new.select(key).subtract(old.select(key)).withColumn("change", F.lit("added"))
            .unionByName(old.select(key).subtract(new.select(key)).withColumn("change", F.lit("removed"))))


def unseen(test: DataFrame, viewed: DataFrame, key: str = "photo_id") -> DataFrame:
    """Test ids nobody has looked at."""
    return test.select(key).subtract(viewed.select(key))


def extend_selection(a: DataFrame, b: DataFrame, key: str = "photo_id") -> DataFrame:
    """Distinct union of two selections."""
    return a.select(key).union(b.select(key)).distinct()


def leak_check(splits: DataFrame, groups: DataFrame, seen: DataFrame, key: str = "photo_id", group: str = "group_id") -> DataFrame:
    """One row: groups present in several splits and previously seen photos outside train."""
    placed = groups.select(key, group).join(splits.select(key, "split"), key)
    crossing = placed.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n")).scalar()
    outside = splits.where(F.col("split") != "train").join(seen.select(key), key, "left_semi")
    return outside.agg(F.count(F.lit(1)).alias("seen_outside_train")).withColumn("crossing_groups", crossing)


# ---------------------------------------------------------------- order, limits, samples


def pilot(df: DataFrame, n: int, key: str = "photo_id") -> DataFrame:
    """First ``n`` rows by canonical id."""
    return df.orderBy(key).limit(n)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "photo_id") -> DataFrame:
    """Repeatable sample without replacement: the ``n`` smallest seeded hashes."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def ordered(df: DataFrame, key: str = "photo_id") -> DataFrame:
    """Id-sorted output, independent of task order."""
    return df.orderBy(key)


def hash_order(df: DataFrame, seed: int, key: str = "photo_id") -> DataFrame:
    """Deterministic shuffle order."""
    return df.withColumn("draw", md5_pick(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))).orderBy("draw", key)
