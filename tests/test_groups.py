"""Pairs, components, splits and quantiles against brute force, with hot keys."""

import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photospark.operators import pairs as P
from photospark.operators import quantiles as Q
from photospark.operators import quotas as K
from photospark.operators import splits as S
from photospark.operators.components import connected_components


def bits(x):
    return bin(x & (1 << 64) - 1).count("1")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def make_hashes(n, seed=3):
    rng = random.Random(seed)
    rows = []
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(8)]
    for i in range(n):
        if i % 3 == 0:
            d, p = base[0]  # a third of all photos are copies of one
        else:
            d, p = base[rng.randrange(8)]
            for _ in range(rng.randrange(7)):
                d ^= 1 << rng.randrange(64)
            for _ in range(rng.randrange(10)):
                p ^= 1 << rng.randrange(64)
        rows.append((i, signed(d), signed(p)))
    return rows


@pytest.mark.parametrize("options", [{}, {"crowd": 10}, {"crowd": 3, "depth": 4}, {"crowd": 5, "depth": 1}])
def test_hamming_pairs_equal_brute_force(spark, options):
    rows = make_hashes(400)
    df = spark.createDataFrame(rows, "id long, d long, p long")
    codes = {}
    for i, d, p in rows:
        codes.setdefault((d, p), []).append(i)
    reps = [(min(v), d, p, len(v)) for (d, p), v in codes.items()]
    want = {(a[0], b[0], bits(a[1] ^ b[1]), bits(a[2] ^ b[2]), a[3], b[3]) for a in reps for b in reps if a[0] < b[0] and bits(a[1] ^ b[1]) <= 4 and bits(a[2] ^ b[2]) <= 8}
    got = [tuple(r) for r in P.near_dup_pairs(df, 4, 8, **options).select("left", "right", "dhash", "phash", "n_left", "n_right").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    links = {tuple(r) for r in P.copy_links(df, ["d", "p"]).collect()}
    assert links == {(min(v), i) for v in codes.values() for i in v if i != min(v)}


def components_of(nodes, links):
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize("options", [{}, {"crowd": 4}, {"crowd": 3, "depth": 2}])
def test_links_are_a_spanning_forest_of_the_pairs(spark, options):
    rows = make_hashes(300, seed=8)
    df = spark.createDataFrame(rows, "id long, d long, p long")
    reps = {}
    for i, d, p in rows:
        reps.setdefault((d, p), i)
    nodes = list(reps.values())
    want = components_of(nodes, [(i, j) for (a, x), i in reps.items() for (b, y), j in reps.items() if i < j and bits(a ^ b) <= 4 and bits(x ^ y) <= 8])
    links = [tuple(r) for r in P.near_dup_links(df, 4, 8, **options).collect()]
    code = {i: c for c, i in reps.items()}
    assert all(bits(code[a][0] ^ code[b][0]) <= 4 and bits(code[a][1] ^ code[b][1]) <= 8 and a < b for a, b in links)
    assert components_of(nodes, links) == want and len(links) == len(nodes) - len(set(want.values()))


def test_a_dense_ball_costs_about_a_link_per_code(spark):
    rng = random.Random(13)
    seen = {0}
    while len(seen) < 6000:
        seen.add(sum(1 << b for b in rng.sample(range(64), 3)))
    df = spark.createDataFrame([(i, signed(c), 5) for i, c in enumerate(sorted(seen))], "id long, d long, p long")
    assert P.near_dup_links(df, 4, 8, crowd=500).count() == 5999


def test_no_codes_have_no_pairs(spark):
    df = spark.createDataFrame([], "id long, d long, p long")
    assert P.near_dup_pairs(df).count() == 0 and P.near_dup_links(df).count() == 0


def test_time_and_visual_proposals(spark):
    h = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, -1, -1)], "id long, d long, p long")
    ctx = spark.createDataFrame([(0, "cam", "2020-01-01 00:00:00"), (1, "cam", None), (2, "cam", "2020-01-01 00:00:02")], "id long, camera string, t string").withColumn("t", F.col("t").cast("timestamp"))
    visual = P.copy_links(h, ["d", "p"]).select("left", "right", F.lit(0).alias("dhash"), F.lit(0).alias("phash"), F.lit("visual_hash").alias("reason"))
    timed = P.with_distances(P.burst_pairs(ctx, ["camera"]), h).select("left", "right", "dhash", "phash", F.lit("capture").alias("reason"))
    got = {(r["left"], r["right"]): (r["dhash"], r["reasons"]) for r in P.merge_pairs(visual, timed).collect()}
    assert got == {(0, 1): (0, ["visual_hash"]), (0, 2): (64, ["capture"])}


def test_every_photo_pair_has_its_reasons(spark):
    """Brute force over all pairs of photos: each is described by a row of its classes with exactly its reasons."""
    rng = random.Random(14)
    looks = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(4)]
    rows = []
    for i in range(160):
        d, p = looks[0 if i % 3 == 0 else rng.randrange(4)]
        if rng.random() < 0.5:
            d ^= 1 << rng.randrange(3)
        camera, us = rng.choice([("a", rng.randrange(12) * 900_000), ("b", rng.randrange(40) * 900_000), ("a", None), (None, 5)])
        rows.append((i, signed(d), signed(p), camera, us))
    df = spark.createDataFrame(rows, "id long, d long, p long, camera string, us long").withColumn("t", F.timestamp_micros("us"))
    got = {(r["left"], r["right"]): set(r["reasons"]) for r in P.related_pairs(df, ["camera"]).collect()}
    code, moment, joint = {}, {}, {}
    for i, d, p, c, us in rows:
        code.setdefault((d, p), i)
        if c is not None and us is not None:
            moment.setdefault((c, us), i), joint.setdefault((d, p, c, us), i)

    def described(a, b, reason):
        a, b = sorted((a, b))
        return a == b or reason <= got.get((a, b), set())

    counts = {"visual_only": 0, "timed_only": 0, "both": 0}
    for x in rows:
        for y in rows[:x[0]]:
            visual = bits(x[1] ^ y[1]) <= 4 and bits(x[2] ^ y[2]) <= 8
            timed = x[3] is not None and x[3] == y[3] and None not in (x[4], y[4]) and abs(x[4] - y[4]) <= 3_000_000
            if visual and timed:
                counts["both"] += 1
                assert described(joint[x[1:]], joint[y[1:]], {P.VISUAL, P.TIMED})
            elif visual:
                counts["visual_only"] += 1
            elif timed:
                counts["timed_only"] += 1
            if visual:
                assert described(code[x[1:3]], code[y[1:3]], {P.VISUAL})
            if timed:
                assert described(moment[x[3:]], moment[y[3:]], {P.TIMED})
            pair = got.get((y[0], x[0]))
            assert pair is None or pair == ({P.VISUAL} if visual else set()) | ({P.TIMED} if timed else set())
    assert P.related_counts(df, ["camera"]).first().asDict() == counts and min(counts.values()) > 0 and all(got.values())


def test_bursts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 4}", rng.randrange(400) * 500_000 - 50_000_000) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, camera string, us long").withColumn("t", F.timestamp_micros("us"))
    at = {}
    for i, c, us in rows:
        at.setdefault((c, us), []).append(i)
    keys = list(at)
    want = {(min(at[a]), min(at[b])) for a in keys for b in keys if a[0] == b[0] and 0 < b[1] - a[1] <= 3_000_000}
    got = [(r["left"], r["right"]) for r in P.burst_pairs(df, ["camera"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    follow = {(r["camera"], r["at"]): (r["following"], r["next_gap"]) for r in P.burst_neighbors(df, ["camera"], bins=2).collect()}
    for c, us in keys:
        near = [b for b in keys if b[0] == c and 0 < b[1] - us <= 3_000_000]
        assert follow[c, us] == (sum(len(at[b]) for b in near), min(b[1] - us for b in near) / 1e6 if near else None)


def test_pending_review_aborts(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "left long, right long")
    with pytest.raises(Exception, match="without a merge/reject"):
        P.reviewed(pairs, spark.createDataFrame([(1, 2, "merge")], "left long, right long, decision string")).collect()


def test_components_with_a_hub_and_a_chain(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 360)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    parent = list(range(620))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    out = connected_components(spark.range(620), spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["id"], r["group"]) for r in out} == {(i, root(i)) for i in range(620)}


def greedy(sizes, ratios=(8, 1, 1)):
    total, counts, out = sum(sizes), [0, 0, 0], []
    for k, s in enumerate(sizes):
        empty = [i for i in range(3) if counts[i] == 0]
        i = empty[0] if len(sizes) - k == len(empty) else max(range(3), key=lambda j: (ratios[j] * total - 10 * counts[j], -j))
        counts[i] += s
        out.append(i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 60)), min_size=1, max_size=8))
def test_allocation_runs_equal_the_greedy_walk(parts):
    classes = {}
    for size, count in parts:
        classes[size] = classes.get(size, 0) + count
    ordered = sorted(classes.items(), reverse=True)
    sizes = [s for s, c in ordered for _ in range(c)]
    if len(sizes) < 3:
        return
    flat, at = [], {}
    for size, start, length, pattern in S.allocate(ordered):
        assert at.get(size, 0) == start
        at[size] = start + length
        flat += [pattern[k % len(pattern)] for k in range(length)]
    assert flat == greedy(sizes)


def test_allocation_work_depends_on_sizes_not_groups():
    assert len(S.allocate([(3, 10**9), (2, 10**9), (1, 10**10)])) < 100


def test_pairs_split_16_2_2(spark):
    df = spark.createDataFrame([(f"a{i:04d}.dng", f"g{i // 2}") for i in range(20)], "photo_id string, group_id string")
    out = S.group_split(df)
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 16, "val": 2, "test": 2}
    assert S.leak_check(out, df, df.limit(0)).first()["crossing_groups"] == 0


def test_every_group_of_its_own_size(spark):
    sizes = list(range(1, 61))
    df = spark.createDataFrame([(f"p{s}_{i}", f"g{s}") for s in sizes for i in range(s)], "photo_id string, group_id string")
    got = dict(S.group_split(df).select("group_id", "split").distinct().collect())
    want = greedy(sizes[::-1])
    assert [got[f"g{s}"] for s in sizes[::-1]] == [S.SPLITS[i] for i in want]


def test_split_of_few_or_no_groups(spark):
    df = spark.createDataFrame([("a", "g1"), ("b", "g2")], "photo_id string, group_id string")
    with pytest.raises(Exception, match="at least three distinct groups"):
        S.group_split(df).collect()
    assert S.group_split(df.limit(0)).collect() == []


def greedy_picks(rows, hashed, quotas, n):
    names, tally, used, want = sorted(rows, key=lambda r: (hashed[r[0]], r[0])), {"a": {}, "b": {}}, set(), []
    while len(want) < n:
        def need(r):
            return sum(max(0, quotas[f].get(v, 0) - tally[f].get(v, 0)) / max(1, quotas[f].get(v, 0)) for f, v in (("a", r[2]), ("b", r[3])))
        free = [r for r in names if r[1] not in used]
        if not free:
            break
        best = max(free, key=need)
        used.add(best[1])
        want.append(best[0])
        for f, v in (("a", best[2]), ("b", best[3])):
            tally[f][v] = tally[f].get(v, 0) + 1
    return want


@pytest.mark.parametrize("block, n", [(4096, 20), (1, 20), (3, 45), (2, 500)])
def test_quota_selection_equals_greedy_rule(spark, block, n):
    rng = random.Random(9)
    rows = [(f"p{i:03d}", rng.choice([f"g{rng.randrange(60)}", "hot"]), rng.choice(["x", "y", "z", None]), rng.choice("lm")) for i in range(200)]
    rows += [(f"q{i}", None, "x", "l") for i in range(3)] + [("r0", "g_only", "y", None)]
    df = spark.createDataFrame(rows, "photo_id string, group_id string, a string, b string")
    quotas = {"a": {"x": 6, "y": 3, "none": 4, "z": 0}, "b": {"l": 5}}
    hashed = {r["photo_id"]: r["h"] for r in df.select("photo_id", S.seeded_hash("photo_id", 42).alias("h")).collect()}
    got = K.quota_select(df, quotas, n, block=block, digits=1).orderBy("pick_order").collect()
    assert [r["photo_id"] for r in got] == greedy_picks(rows, hashed, quotas, n)
    assert [r["pick_order"] for r in got] == list(range(len(got)))


def test_quota_selection_of_nothing(spark):
    df = spark.createDataFrame([], "photo_id string, group_id string, a string, b string")
    assert K.quota_select(df, {"a": {"x": 2}, "b": {}}, 5).count() == 0
    one = spark.createDataFrame([("p", "g", "x", "l")], df.schema)
    assert K.quota_select(one, {"a": {"x": 2}, "b": {}}, 0).count() == 0
    assert [r["pick_order"] for r in K.quota_select(one, {"a": {}, "b": {}}, 5).collect()] == [0]


def test_percentiles_equal_a_full_sort(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": np.r_[rng.normal(size=3000), np.zeros(2000)], "ties": np.repeat([1.0, 2.0], 50), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.95, 1.0]
    got = {(r["k"], r["p"]): r["value"] for r in Q.exact_percentiles(df, ["k"], "v", probs).collect()}
    for k, vs in groups.items():
        for p in probs:
            assert abs(got[k, p] - np.percentile(vs, p * 100)) < 1e-9
    whole = np.concatenate(list(groups.values()))
    row = Q.percentile_struct(df, "v", {"a": 0.25, "b": 0.9}).first()
    assert abs(row["a"] - np.percentile(whole, 25)) < 1e-9 and abs(row["b"] - np.percentile(whole, 90)) < 1e-9


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 13).alias("v")).repartition(4)
    rows = Q.global_rank(df, [F.desc("v"), F.col("id")]).collect()
    want = sorted(((r["v"], r["id"]) for r in rows), key=lambda t: (-t[0], t[1]))
    assert [(r["v"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"])] == want and {r["rank"] for r in rows} == set(range(1, 3001))


def test_percentiles_of_ordered_input(spark):
    df = spark.range(0, 400_000, 1, 8).select(F.col("id").cast("double").alias("v"))
    assert Q.exact_percentiles(df, [], "v", [0.5]).first()["value"] == 199_999.5


def test_order_keys_are_exact_and_ordered(spark):
    rng = random.Random(12)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)]
    values += [s * v for s in (1, -1) for e in range(-1074, 1024) for v in (2.0 ** e,)] + [s * (2.0 ** e + d * 2.0 ** (e - 52)) for s in (1, -1) for e in (-1000, -1, 0, 1, 52, 1000) for d in (-0.5, 1)]
    values += [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    values = [v for v in values if v == v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", Q.order_key(F.col("v")).alias("k")).select("v", "k", Q.key_value(F.col("k")).alias("back")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["k"] == (-bits if r["v"] < 0 else bits) and r["back"] == r["v"]
    nan = spark.createDataFrame([(math.nan,), (math.inf,)], "v double").select(Q.order_key(F.col("v")).alias("k")).collect()
    assert nan[0]["k"] > nan[1]["k"]


def test_percentiles_of_odd_values(spark):
    far = [-1e308, -1e-300, -5e-324, 0.0, 5e-324, 1e-300, 1e-5, 1.0, 1e300]
    rows = [("a", v) for v in far] + [(None, 3.0), (None, 3.0), ("gone", None), ("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("inf", math.inf)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["p"]): r["value"] for r in Q.exact_percentiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert got["a", p] == pytest.approx(np.percentile(far, p * 100), rel=1e-12)
    assert got[None, 0.5] == 3.0 and ("gone", 0.5) not in got and got["nan", 0.0] == 1.0 and math.isnan(got["nan", 1.0]) and got["inf", 0.5] == math.inf
    assert Q.exact_percentiles(df.where("k = 'none'"), ["k"], "v", [0.5]).count() == 0
