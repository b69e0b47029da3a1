"""Findings of round 3 on the training-data operators."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from photospark.llm import buckets, components, lines, resharding
from photospark.llm.stage import Stage


def test_resharding_copies_no_table_that_is_read_from_files(spark, tmp_path):
    rng = random.Random(31)
    rows = [(rng.choice([None, 7, i]), rng.choice([None, "", "é" * rng.randrange(1, 40)]), rng.choice("aab")) for i in range(300)]
    for k in (0, 1):
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.mode("append").parquet(str(tmp_path / "documents"))
    stage = Stage(spark, "t")
    out = resharding.reshard_files(spark.read.parquet(str(tmp_path / "documents")), F.col("source"), stage, 5)
    got = out.collect()
    key = lambda i, t: (i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(key(i, t) for i, t, _ in rows * 2)
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(120)) for s in range(5))
    left = os.listdir(stage.root.removeprefix("file:"))
    assert sorted(left) == ["files", "placement"]


@pytest.mark.parametrize("few", [components.FEW, 10])
def test_components_by_one_task_or_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(32)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(60)] + [(5, 5)]
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    spark.sparkContext.setJobGroup(f"components {few}", "")
    got = components.components(spark.createDataFrame(pairs, "u long, v long"), Stage(spark, "t"), "g")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["root"] for r in got.collect()} == root and (few < len(pairs) or jobs <= 4)
    assert components.components(spark.createDataFrame([], "u long, v long"), Stage(spark, "t"), "g").count() == 0


def test_buckets_travel_packed_and_whole(spark, monkeypatch):
    for x in (np.zeros(0, np.uint64), np.zeros(3, np.uint64), np.array([0, 255, 256], np.uint64), np.array([2**64 - 1], np.uint64)):
        if len(x):
            assert (buckets.unpacked(buckets.packed(x), len(x)) == x).all()
    monkeypatch.setattr(buckets, "RUN", 300)
    rng = random.Random(33)
    keys = [rng.randrange(2**64) >> buckets.CUT << buckets.CUT for _ in range(200)]
    rows = [(rng.choice([-(2**63), 2**63 - 1]) + 0 if k < 2 else rng.randrange(-(2**63), 2**63), rng.sample(keys, 4) + [rng.randrange(2**64)]) for k in range(500)]
    rows = list({n: (n, [x - (x >> 63 << 64) for x in ks]) for n, ks in rows}.values())

    def keys_of(batch):
        lists = batch.column(1)
        yield np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().view(np.uint64)

    got = buckets.gather(spark.createDataFrame(rows, "node long, keys array<long>"), keys_of, 2500).collect()
    want: dict = {}
    for n, ks in rows:
        for k in ks:
            want.setdefault((k & (2**64 - 1)) >> buckets.CUT, set()).add(n)
    more = sorted((k, n, min(v), max(v)) for k, v in want.items() if len(v) > 2 for n in v)
    assert sorted((r["key"], r["node"], r["a"], r["z"]) for r in got if r["key"] is not None) == more
    assert sorted((r["a"], r["node"]) for r in got if r["key"] is None) == sorted((min(v), max(v)) for v in want.values() if len(v) == 2)


def test_unlike_lines_are_told_apart_without_their_distance(monkeypatch):
    rng = random.Random(34)
    for _ in range(3000):
        a = "".join(rng.choices("abé ", k=rng.randrange(60)))
        b = list(a)
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = rng.choice(["", "a", "é"])
        b = "".join(b)
        limit = (1 - lines.SIMILAR) * max(len(a), len(b))
        assert lines.similar(a, b) == (abs(len(a) - len(b)) <= limit and lines.edits(a, b) <= limit)
    monkeypatch.setattr(lines, "edits", None)
    assert not lines.similar("the harbour was closed for the winter months", "quite another text of the very same length it")
