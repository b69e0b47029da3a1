"""Small cases of the findings of the reviews."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_recipes_are_read_where_photos_are_resampled(spark):
    from photospark.operators import features as E
    from photospark.operators import resample as R
    from photospark.operators import tiles as T

    rng = np.random.default_rng(3)
    rows = [(k, y, x, *[int(c) for c in rng.integers(0, 256 >> k, 3)]) for k, (h, w) in enumerate([(9, 30), (21, 8), (5, 5)]) for y in range(h) for x in range(w)]
    tiles = T.cut_tiles(spark.createDataFrame(rows, "photo long, y int, x int, r int, g int, b int"), 8, 8)
    got = R.recipe_tiles(tiles, 16, 20)
    assert len(exchanges(got)) - len(exchanges(tiles)) == 1 and "posexplode" not in got._jdf.queryExecution().toString().lower()
    want = {r["photo"]: r for r in E.select_recipe(R.resize_tiles(tiles, 16, 20)).collect()}
    assert len(want) == 3
    for r in got.collect():
        assert r["recipe"] == want[r["photo"]]["recipe"]
        assert all(math.isclose(r[c], want[r["photo"]][c], rel_tol=1e-12) for c in ("median", "p95"))


def test_resume_status_is_a_join_of_columns(spark):
    from photospark.streaming import jobs

    keys = ["photo", "content"]
    batch = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("b", None, 2), ("c", "z", 3), (None, None, 4)], "photo string, content string, v int")
    seen = spark.createDataFrame([("b", None), ("c", "y"), (None, None)], "photo string, content string")
    got = jobs.resume_status(batch, seen, keys)
    assert got.columns == ["photo", "content", "v", "status", "copies"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", "x", 1, "processed", 2), ("b", None, 2, "cached", 1), ("c", "z", 3, "processed", 1), (None, None, 4, "cached", 1)]))
    assert "pandas" not in got._jdf.queryExecution().toString().lower()


def test_phash_decides_equal_frequencies_in_a_fixed_order(spark):
    from photospark.operators import features as E

    n, rng = 8, np.random.default_rng(5)
    grids = {k: (lambda a: np.triu(a) + np.triu(a, 1).T)(rng.integers(0, 256, (n, n))) for k in range(40)}  # transposed frequencies are equal
    rows = [(k, y, x, float(a[y, x])) for k, a in grids.items() for y in range(n) for x in range(n)]
    frame = spark.createDataFrame(rows, "photo long, y int, x int, v double")
    wave = lambda k, at: math.cos((2 * at + 1) * k * math.pi / 16) * 1.0
    scale = [math.sqrt((1 if k == 0 else 2) / n) for k in range(n)]
    want = {}
    for k, a in grids.items():
        sums = []
        for f in range(64):
            total = 0.0
            for y in range(n):
                for x in range(n):
                    total += float(a[y, x]) * wave(f % 8, x) * wave(f // 8, y) * scale[f % 8] * scale[f // 8]
            sums.append(total)
        middle = sorted(sums[1:])[31]
        bits = sum(1 << f for f in range(1, 64) if sums[f] > middle)
        want[k] = bits - (1 << 64) if bits >= 1 << 63 else bits
    for parts in (1, 7):
        assert {r["photo"]: r["phash"] for r in E.phash(frame.repartition(parts), n).collect()} == want


def test_a_difference_of_equal_tables_is_empty_without_broadcasts(spark):
    from photospark.checks import load_checks
    from photospark.session import UNIONS

    was = {k: spark.conf.get(k) for k in (UNIONS, "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set(UNIONS, "true")  # Spark's own value, as in a session made elsewhere
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = load_checks()["a52_crop_consistency"].run(spark, "/root/testdata/sf0.001")
        assert found.first()["different"] == 0
    finally:
        for k, value in was.items():
            spark.conf.set(k, value)


def test_the_text_of_an_object_is_not_shuffled(spark, tmp_path):
    from photospark.sources import objects as O

    (tmp_path / "o.json").write_text('{"a": {"A": {"Exposure": 1}}, "b\\\\\\"}": {"A": {"Tint": 2}}}')
    df = O.read_object(spark, str(tmp_path / "o.json"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "ResolvedHint" not in plan and "strategy=broadcast" in plan
    assert sorted(r["entry"].strip() for r in df.collect()) == ['"a": {"A": {"Exposure": 1}}', '"b\\\\\\"}": {"A": {"Tint": 2}}']


def dense_codes(spark, n=300, seed=9):
    """Short codes, so alike that cells of the first level would not halve the pairs."""
    rng = np.random.default_rng(seed)
    codes = list(dict.fromkeys((int(a), int(b)) for a, b in zip(rng.integers(0, 1 << 8, n), rng.integers(0, 1 << 8, n))))
    return codes, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(codes)], "id long, d long, p long")


def near_of(codes, d, p):
    bits = lambda x: bin(x).count("1")
    return {(i, j): (bits(a[0] ^ b[0]), bits(a[1] ^ b[1])) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and bits(a[0] ^ b[0]) <= d and bits(a[1] ^ b[1]) <= p}


def test_dense_codes_are_one_cell_and_small_crowds_make_no_copies(spark):
    from photospark.operators import pairs as P

    codes, df = dense_codes(spark)
    hashed = P.hash_codes(df)
    assert P._whole(hashed, P.split_tree(32, 2, 3, 4)[0]) == len(codes)
    spread = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63), i, i, 1) for i in range(500)], "d long, p long, rep long, n long")
    assert P._whole(spread, P.split_tree(64, 4, 8, 3)[0]) is None
    want = near_of(codes, 2, 3)
    for piece in (P.PIECE, 7):
        got = [((r["rep_l"], r["rep_r"]), (set_bits(r["d_l"] ^ r["d_r"]), set_bits(r["p_l"] ^ r["p_r"]))) for r in P.code_pairs(hashed, 2, 3, 32, 20, 4, piece).collect()]
        assert len(got) == len(want) > 100 and dict(got) == want
    # rows sent for a comparison: each code goes to one place per piece, whatever ``crowd`` says
    met = P.near_dup_pairs(df, 2, 3, bits=32, crowd=2, depth=4)
    assert met.count() == len(want) and "Generate explode(sequence" in met._jdf.queryExecution().executedPlan().toString()


def set_bits(x):
    return bin(x & (1 << 64) - 1).count("1")


def test_branches_are_read_from_one_search(spark):
    from photospark.operators import pairs as P

    _, df = dense_codes(spark)
    branches = {"low": (1, 3), "wide": (2, 4), "tilted": (4, 1)}
    parts = [P.near_dup_pairs(df, d, p, bits=32).withColumn("branch", F.lit(name)) for name, (d, p) in branches.items()]
    want = {(r["left"], r["right"]): {k: tuple(v) for k, v in r["matches"].items()} for r in P.merge_branches(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    found = P.near_dup_branches(df, branches, bits=32)
    got = {(r["left"], r["right"]): {k: (r["dhash"], r["phash"]) for k in branches if r[k]} for r in found.collect()}
    assert got == want and len(got) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]  # no pair is shuffled


def test_related_pairs_are_not_shuffled_and_links_have_their_groups(spark):
    from photospark.operators import components as CC
    from photospark.operators import pairs as P

    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 6)) * 5, int(rng.integers(0, 4)) * 3, *([None, None] if i % 9 == 0 else [int(rng.integers(0, 5)), 1_700_000_000 + int(rng.integers(0, 400))])) for i in range(220)]
    shots = spark.createDataFrame(rows, "id long, d long, p long, camera long, s long").selectExpr("id", "d", "p", "camera", "timestamp_seconds(s) AS t")
    pairs = P.related_pairs(shots, ["camera"], 1, 1, 16, gap_seconds=6)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]
    found = [tuple(r)[:2] for r in pairs.collect()]
    assert len(found) == len(set(found)) > 200 and all(a < b for a, b in found)
    accept = lambda left, right: (left + right) % 7 > 3
    edges = spark.createDataFrame([p for p in found if accept(*p)], "u long, v long")
    groups = lambda links: {r["id"]: r["group"] for r in CC.connected_components(shots.select("id"), links).collect()}
    want = groups(edges)
    assert groups(P.related_links(shots, ["camera"], accept, 1, 1, 16, gap_seconds=6)) == want and len(set(want.values())) > 1


def test_hash_view_is_one_pass_and_equals_its_text(spark):
    from photospark.checks.views import View

    v = View(spark, "/root/testdata/sf0.001")
    assert sorted(v.hashes.collect()) == sorted(v.sql("SELECT * FROM hashes", "hashes").collect())


def test_same_rows_groups_the_union_once(spark):
    from photospark.operators import metrics as M

    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", None), ("y", None), ("w", 4)], "k string, v int")
    out = M.same_rows(a, b, ["k", "v"])
    assert tuple(out.first()) == (2, 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 4  # each one holds all keys of its task


def test_baselines_make_their_targets_once_and_draws_are_spread(spark):
    from photospark.checks.eval_checks import preds, pscores
    from photospark.checks.views import View
    from photospark.operators import gates as G

    v = View(spark, "/root/testdata/sf0.001")
    plan = preds(v)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "cut-" in plan
    assert pscores(v).where("exposure_error IS NULL OR recovery_error IS NULL").count() == 0
    errors = spark.range(300).selectExpr("id % 150 AS group_id", "1.0D + id AS control", "2.0D + id AS candidate")
    wide, narrow = (G.paired_bootstrap(errors, 20, 3, width=w) for w in (150, 16))
    assert wide.first()["low"] < 0 and narrow.first()["low"] < 0
    assert "REPARTITION_BY_NUM" in narrow._jdf.queryExecution().executedPlan().toString()
