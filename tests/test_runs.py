"""Manifests, triage, accounting, incremental runs, sinks, splits and gates: what must be refused is refused."""

import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from photospark.operators import gates as G
from photospark.operators import lineage as N
from photospark.operators import metrics as M
from photospark.operators import status as ST
from photospark.plans.splits import load_or_create_split
from photospark.sources import catalog as C
from photospark.sources import files as FS
from photospark.sources import sinks as K


def test_two_field_score_units(spark):
    rows = [("m", 1, "Exposure", 0.25, 0.0), ("m", 1, "HighlightRecovery", 0.2, 0.0)]
    df = spark.createDataFrame(rows, "model string, photo long, parameter string, pred double, truth double")
    p2 = M.two_field_score(M.with_errors(df), ["model", "photo"]).first()["p2"]
    assert abs(p2 - 0.5 * (1 / 8 + 10 / 100)) < 1e-12


def test_manifest_gate(spark):
    f = spark.createDataFrame([("a.dng", "c"), ("b.dng", "c")], "photo_id string, config_hash string")
    m = lambda *v: spark.createDataFrame([v], "status string, scope string, config_hash string")
    none, leak = f.select("photo_id").limit(0), f.select("photo_id").limit(1)
    assert C.require_manifest(f, m("complete", "full", "c"), none).count() == 2
    for manifest, bad in ((m("failed", "full", "c"), none), (m("complete", "other", "c"), none), (m("complete", "full", "d"), none), (m("complete", "full", "c"), leak)):
        with pytest.raises(Exception, match="do not match a complete manifest"):
            C.require_manifest(f, manifest, bad).collect()


def test_feature_contract(spark):
    ok = [0.5] * 132
    rows = [("a.dng", ok, [1.0] * 6, [0.0] * 6, "c")]
    df = spark.createDataFrame(rows, C.FEATURES_SCHEMA)
    assert C.check_features(df).count() == 1
    for x, std in ((ok[:-1], [0.0] * 6), ([float("nan")] + ok[1:], [0.0] * 6), (ok, [-1.0] + [0.0] * 5)):
        with pytest.raises(Exception, match="breaks its contract"):
            C.check_features(spark.createDataFrame([("a.dng", x, [1.0] * 6, std, "c")], C.FEATURES_SCHEMA)).collect()


def test_support_triage(spark):
    inputs = spark.createDataFrame([("a",), ("b",)], "photo_id string")
    fail = lambda r: spark.createDataFrame([("b", r)], "photo_id string, error string")
    none = inputs.limit(0)
    got = {r["photo_id"]: r["status"] for r in ST.finalize_support(inputs, fail("no wb"), none, "no wb").collect()}
    assert got == {"a": "success", "b": "unsupported"}
    with pytest.raises(Exception, match="another reason"):
        ST.finalize_support(inputs, fail("disk"), none, "no wb").collect()
    with pytest.raises(Exception, match="supported header"):
        ST.finalize_support(inputs, fail("no wb"), inputs.where("photo_id = 'b'"), "no wb").collect()


def test_accounting_must_add_up(spark):
    inputs = spark.range(4).select(F.col("id").alias("photo_id"))
    results = spark.createDataFrame([("processed",), ("cached",), ("filtered",), ("failed",)], "status string")
    row = N.run_accounting(results, inputs).first()
    assert (row["success_count"], row["cached_count"], row["status"]) == (2, 1, "failed")
    with pytest.raises(Exception, match="account for every input"):
        N.run_accounting(results.limit(3), inputs).collect()


def test_incremental_recomputes_changed_sources(spark):
    inputs = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3")], "id string, sig string")
    cache = spark.createDataFrame([("a", "s1", 1), ("b", "old", 2)], "id string, sig string, x int")
    out = N.incremental(inputs, cache, lambda t: t.withColumn("x", F.lit(9)), ["id", "sig"])
    assert {(r["id"], r["x"], r["status"]) for r in out.collect()} == {("a", 1, "cached"), ("b", 9, "processed"), ("c", 9, "processed")}


def test_config_guard():
    N.guard_config("a", None)
    N.guard_config("a", "b", rebuild=True)
    with pytest.raises(ValueError, match="configuration changed"):
        N.guard_config("a", "b")
    with pytest.raises(ValueError, match="pilot"):
        N.guard_config("a", "a", scope="pilot", prior_scope="full")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.range(500).select("id", (F.col("id") * 2).alias("v"))
    same = N.fingerprint(a.orderBy(F.desc("id")).repartition(3), ["id", "v"]).first()
    assert same == N.fingerprint(a, ["id", "v"]).first()
    assert N.fingerprint(a.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))), ["id", "v"]).first() != same


def test_exclusive_and_immutable_writes(spark, tmp_path):
    df = spark.range(3)
    K.write_new(df, f"{tmp_path}/run")
    with pytest.raises(Exception, match="(?i)already exists"):
        K.write_new(df, f"{tmp_path}/run")
    first = K.snapshot(df, str(tmp_path))
    assert K.snapshot(df.orderBy(F.desc("id")), str(tmp_path)) == first
    assert K.snapshot(spark.range(4), str(tmp_path)) != first
    run = df.limit(1).select(F.lit("r").alias("run"))
    K.open_test(run, f"{tmp_path}/opened")
    with pytest.raises(Exception, match="(?i)already exists"):
        K.open_test(run, f"{tmp_path}/opened")
    N.run_status(spark, f"{tmp_path}/status", "r1", "running")
    N.run_status(spark, f"{tmp_path}/status", "r1", "failed", "disk")
    assert N.latest_status(spark.read.parquet(f"{tmp_path}/status")).first()["reason"] == "disk"


def test_frozen_files_are_verified(spark, tmp_path):
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(name.encode())
    read = lambda: N.freeze(spark.read.format("binaryFile").load(str(tmp_path)))
    manifest = spark.createDataFrame(read().collect(), read().schema)
    assert N.verify(read(), manifest).count() == 0
    (tmp_path / "b.bin").write_bytes(b"tampered")
    (tmp_path / "c.bin").write_bytes(b"new")
    assert sorted(r["problem"] for r in N.verify(read(), manifest).collect()) == ["changed", "unexpected"]


def test_photo_folder_and_archives(spark, tmp_path):
    for name in ("A.dng", "b.DNG", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["photo_id"] for r in FS.scan_photos(spark, str(tmp_path)).collect()) == ["a.dng", "b.dng"]
    (tmp_path / "B.dng").write_bytes(b"y")
    with pytest.raises(Exception, match="name collision"):
        FS.scan_photos(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no inputs"):
        FS.require_inputs(FS.list_files(spark, str(tmp_path), "*.raw"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("low/1.png", b"1")
        z.writestr("high/1.png", b"22")
    (tmp_path / "p.zip").write_bytes(buffer.getvalue())
    m = FS.scan_archives(spark, str(tmp_path)).withColumn("name", F.regexp_extract("member", "/(.*)$", 1))
    assert M.pair_branches(m.where("branch = 'low'").select("name"), m.where("branch = 'high'").select("name"), "name").count() == 1
    with pytest.raises(Exception, match="different members"):
        M.pair_branches(m.where("branch = 'low'").select("name"), m.where("branch = 'none'").select("name"), "name").collect()


def test_split_is_reused_or_refused(spark, tmp_path):
    photos = spark.createDataFrame([(f"a{i:04d}.dng", f"g{i // 2}") for i in range(20)], "photo_id string, group_id string")
    path = f"{tmp_path}/split"
    first = {tuple(r) for r in load_or_create_split(spark, photos, path, "v1").collect()}
    assert {tuple(r) for r in load_or_create_split(spark, photos, path, "v1").collect()} == first
    for version, seed, data in (("v2", 42, photos), ("v1", 43, photos), ("v1", 42, photos.limit(10))):
        with pytest.raises(ValueError, match="stale"):
            load_or_create_split(spark, data, path, version, seed)


def test_alignment_needs_equal_ids(spark):
    p, t = spark.range(3).withColumn("pred", F.lit(1)), spark.range(4).withColumn("truth", F.lit(1))
    with pytest.raises(Exception, match="different ids"):
        M.align(p, t, ["id"]).collect()


def test_promotion_decision(spark):
    runs = spark.createDataFrame([(1, 1.0, 0.9), (2, 1.0, 0.9), (3, 1.0, 1.01)], "seed int, control double, candidate double")
    fields = spark.createDataFrame([("e", 1.0, 1.01)], "field string, control double, candidate double")
    decide = lambda f, low: G.promotion_gates(runs, f, spark.createDataFrame([(low, 0.2)], "low double, high double")).first()
    assert decide(fields, 0.01)["decision"] == "eligible_for_further_acceptance"
    assert decide(fields, -0.01)["decision"] == "retain_control"
    assert not decide(fields.withColumn("candidate", F.lit(1.03)), 0.01)["delivered_fields_within_2_percent"]


def test_patience_stop(spark):
    vals = [5, 4, 6, 3, 7, 7, 7, 1]
    h = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(vals)], "run string, epoch long, val double")
    row = M.best_epoch(h, 3, bins=2).first()
    assert (row["best_epoch"], row["best_val"], row["epochs_run"]) == (4, 3.0, 7)
    assert M.best_epoch(h, 5, bins=2).first()["best_epoch"] == 8


def test_bootstrap_of_equal_gains_is_exact(spark):
    e = spark.createDataFrame([(f"g{i % 7}", 1.0 + i % 3, 0.9 * (1.0 + i % 3)) for i in range(40)], "group_id string, control double, candidate double")
    row = G.paired_bootstrap(e, 50, 3).first()
    assert abs(row["low"] - 0.1) < 1e-9 and abs(row["high"] - 0.1) < 1e-9


def test_bootstrap_picks_are_dealt_in_two_levels(spark):
    """Every draw takes as many groups as there are; the interval equals one from picks made by hand."""
    groups, draws, seed, width = 23, 40, 5, 4
    pick = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    dealt = {(r["draw"], r["bucket"]): r["picks"] for r in G.bucket_draws(spark, groups, draws, seed, width).collect()}
    assert all(sum(n for (d, _), n in dealt.items() if d == draw) == groups for draw in range(draws)) and len(dealt) <= draws * 6
    sums = [(1.0 + k, 0.5 + k * 0.9) for k in range(groups)]
    gains = []
    for draw in range(draws):
        mine = [b * width + pick(f"{seed}-{draw}-{b}-{j}") % min(width, groups - b * width) for (d, b), n in dealt.items() if d == draw for j in range(1, n + 1)]
        assert len(mine) == groups and max(mine) < groups
        gains.append(1 - sum(sums[k][1] for k in mine) / sum(sums[k][0] for k in mine))
    e = spark.createDataFrame([(f"g{k:02d}", a / 2, b / 2) for k, (a, b) in enumerate(sums) for _ in range(2)], "group_id string, control double, candidate double")
    row = G.paired_bootstrap(e, draws, seed, width=width).first()
    assert [row["low"], row["high"]] == pytest.approx(np.quantile(gains, [0.025, 0.975]).tolist())


def test_a_failed_replacement_leaves_the_old_data(spark, tmp_path):
    path = str(tmp_path / "table")
    K.write_atomic(spark.range(5), path)
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        K.write_atomic(broken, path)
    assert spark.read.parquet(path).count() == 5
    K.write_atomic(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_stream_resumes_by_the_batch_rule(spark, tmp_path):
    from photospark.streaming import jobs

    form, keys = "photo string, config string, source string, content string, v int", ["photo", "config", "source", "content"]
    batches = [
        [("a", "c1", "s", "x", 1), ("b", "c1", "s", "y", 2), ("a", "c1", "s", "x", 1), (None, "c1", "s", None, 3)],
        [("a", "c1", "s", "x", 1), ("b", "c1", "s", "z", 4), (None, "c1", "s", None, 3), ("d", "c1", "s", "w", 5)],  # replayed, changed, replayed, new
        [("a", "c2", "s", "x", 1), ("b", "c1", "s", "y", 2), ("b", "c1", "t", "z", 4)]]  # other configuration, back to a known content, other source
    want = {0: ["processed"] * 3, 1: ["cached", "cached", "processed", "processed"], 2: ["cached", "processed", "processed"]}
    work = lambda b: b.select(*keys, (b.v * 10).alias("r"))
    cache = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame(rows, form).schema)
        jobs.ingest_new(stream, keys, work, str(tmp_path / "out"), str(tmp_path / "done")).awaitTermination()
        log = spark.read.parquet(str(tmp_path / "out/log")).where(f"epoch = {k}").collect()
        assert sorted(r["status"] for r in log) == sorted(want[k]) and sum(r["copies"] for r in log) == len(rows)
        fresh = spark.createDataFrame(rows, form).dropDuplicates(keys).where("photo IS NOT NULL")
        known = spark.createDataFrame([], f"{form.rsplit(',', 1)[0]}, r int") if cache is None else spark.createDataFrame(cache, f"{form.rsplit(',', 1)[0]}, r int")
        batch = N.incremental(fresh, known, work, keys)
        status = {tuple(r[c] for c in keys): r["status"] for r in batch.collect()}
        assert status == {tuple(r[c] for c in keys): r["status"] for r in log if r["photo"] is not None}
        new = [tuple(r) for r in batch.where("status = 'processed'").drop("status").collect()]
        cache = (cache or []) + new
        done = spark.read.parquet(str(tmp_path / "out/results")).drop("epoch").where("photo IS NOT NULL").collect()
        assert sorted(map(tuple, done)) == sorted(cache)
