"""Hand values and invariants of pixel features, tone and color maps, white balance and scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photospark.functions import color as K
from photospark.operators import adjust as A
from photospark.operators import features as E
from photospark.operators import scene as S


def image(spark, array, photo=1):
    h, w, _ = array.shape
    return spark.createDataFrame([(photo, y, x, *[int(v) for v in array[y, x]]) for y in range(h) for x in range(w)], "photo long, y int, x int, r int, g int, b int")


def back(df, cols=("r", "g", "b")):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1, 3))
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in cols]
    return out


def test_constant_lab_image(spark):
    lab = spark.createDataFrame([(1, y, x, 20.0, 250.0, -250.0) for y in range(6) for x in range(4)], "photo long, y int, x int, L double, a double, b double")
    x = np.array(E.features_132(lab).first()["x"])
    assert x.shape == (132,) and x[6] == 1 and x[63] == 1 and x[64] == 1 and np.isclose(x[:96].sum(), 3)
    thirds = x[96:114].reshape(3, 6)
    assert (thirds == [20, 250, -250, 0, 0, 0]).all()
    assert (x[114:120] == [20, 250, -250, 0, 0, 0]).all() and (x[120:] == 0).all()


def test_thirds_follow_array_split(spark):
    for h in (3, 4, 5, 6, 7, 8, 100):
        want = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(h), 3))])
        rows = spark.range(h).select("id", E.third_of(F.col("id"), F.lit(h)).alias("t")).orderBy("id").collect()
        assert [r["t"] for r in rows] == want.tolist()


def test_wide_gamut_matrix():
    want = np.array(K.RGB_TO_XYZ) @ np.linalg.inv(np.array(K.RGB_TO_WIDE))
    assert np.allclose(K.wide_to_xyz_matrix(), want, atol=1e-12)


def test_shadow_curve_rises_and_ends(spark):
    df = spark.range(4097).select((F.col("id") / 4096).alias("y"))
    for s in (0.0, 0.5, 1.0):
        v = np.array([r["v"] for r in df.select("y", K.shadow_curve(F.col("y"), F.lit(s)).alias("v")).orderBy("y").collect()])
        y = np.arange(4097) / 4096
        assert (np.diff(v) > 0).all() and (v >= y).all() and np.allclose(v[y >= 0.55], y[y >= 0.55])


def test_tone_map_is_monotone_and_keeps_ratios(spark):
    linear = spark.range(1000).select(F.lit(1).cast("long").alias("photo"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), (F.col("id") / 999).alias("r"), (F.col("id") / 999 * 0.7).alias("g"), (F.col("id") / 999 * 0.3).alias("b"))
    params = spark.createDataFrame([(1, 2.0, 50.0, 1.0)], "photo long, exposure double, recovery double, strength double")
    rows = sorted(A.apply_tone(linear, params).collect(), key=lambda r: r["x"])
    r, g = np.array([q["r"] for q in rows]), np.array([q["g"] for q in rows])
    assert (np.diff(r) > 0).all() and r.max() <= 1 and np.allclose(g[1:] / r[1:], 0.7)
    still = A.apply_tone(linear, spark.createDataFrame([(1, 2.0, 50.0, 0.0)], "photo long, exposure double, recovery double, strength double"))
    assert all(abs(q["r"] - q["x"] / 999) < 1e-12 for q in still.collect())


def test_gray_ramp_with_hostile_proposal(spark):
    ramp = np.repeat(np.arange(256)[None, :, None], 3, axis=2)
    hostile = np.stack([255 - ramp[..., 0], ramp[..., 1], ramp[..., 2] // 2], axis=-1)
    both = E.join_pixels(image(spark, ramp), image(spark, hostile))
    out = A.protect_color(both, E.natural_settings(both))
    px = back(out, ("out_r", "out_g", "out_b"))[0]
    assert (px == px[:, :1]).all() and (np.diff(px[:, 0]) >= 0).all() and px[0, 0] == 0 and px[-1, 0] == 255
    assert A.endpoint_guard(out).first()["accepted"]
    steps = A.monotone_steps(out, ["photo", "y"], "x", "out_r").first()
    assert steps["decreasing"] == 0 and steps["points"] == 256


def test_random_image_gets_no_new_endpoints(spark):
    rng = np.random.default_rng(12)
    a, b = rng.integers(0, 256, (20, 30, 3)), rng.integers(0, 256, (20, 30, 3))
    a[0, 0], a[0, 1] = 0, 255
    both = E.join_pixels(image(spark, a), image(spark, b))
    g = A.endpoint_guard(A.protect_color(both, E.natural_settings(both))).first()
    assert g["new_black"] == 0 and g["new_full"] == 0 and g["accepted"]
    lifted = A.lift_shadows(image(spark, a), spark.createDataFrame([(1, 1.0)], "photo long, strength double"))
    assert (back(lifted, ("out_r", "out_g", "out_b")) >= a).all()


def test_identity_white_balance_changes_nothing(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (10, 10, 3))
    coef = np.zeros((11, 3))
    coef[:3] = np.eye(3)
    out = A.apply_wb(image(spark, a), spark.createDataFrame([(1, coef.ravel().tolist())], "photo long, coef array<double>"))
    assert (back(out, ("out_r", "out_g", "out_b")) == a).all() and A.wb_guard(out).first()["accepted"]


def test_color_fit_recovers_a_known_map(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (30, 30, 3))
    b = np.stack([a[..., 1], a[..., 2], a[..., 0]], axis=-1)
    row = A.fit_color_poly(E.join_pixels(image(spark, a), image(spark, b))).first()
    want = np.zeros((11, 3))
    want[1, 0] = want[2, 1] = want[0, 2] = 1
    assert row["rank"] == 11 and np.allclose(np.array(row["coef"]).reshape(11, 3), want, atol=1e-6)
    flat = np.full((8, 8, 3), 120)
    assert A.fit_color_poly(E.join_pixels(image(spark, flat), image(spark, flat))).first()["rank"] < 11


def constant(rgb, shape=(64, 96)):
    return np.tile(np.array(rgb), (*shape, 1))


def test_neutral_evidence_reasons(spark):
    def reason(src, out):
        both = E.join_pixels(image(spark, src), image(spark, out), "out_")
        return A.neutral_evidence(E.with_dims(both)).first()["reason"]

    cast, gray = constant([115, 140, 115], (16, 24)), constant([128, 128, 128], (16, 24))
    assert reason(cast, gray) == ""
    assert reason(cast, cast) == "no_supported_neutral_improvement"
    assert reason(constant([250, 10, 10], (16, 24)), gray) == "insufficient_neutral_candidates"


def test_warmth_is_protected_only_by_scene(spark):
    px = image(spark, constant([153, 135, 128], (16, 24)))
    def held(sunset, indoor):
        scene = spark.createDataFrame([(1, sunset, indoor)], "photo long, near_sunset boolean, both_indoor boolean")
        return A.warm_evidence(px, scene).first()["protected"]
    assert held(True, False) and held(False, True) and not held(False, False)


def scene_rows(spark, lighting, subject="people", other=None):
    rows = []
    for view, light in (("full_frame", lighting), ("center_crop", other or lighting)):
        rows += [(1, view, "lighting", n, 0.30 if n == light else 0.10) for n in S.LIGHTING] + [(1, view, "subject", n, 0.30 if n == subject else 0.10) for n in S.SUBJECTS]
    return spark.createDataFrame(rows, "photo long, view string, family string, label string, score double")


@pytest.mark.parametrize("lighting, subject, other, median, caps, reasons", [
    ("daylight", "people", None, 0.5, (0.35, 0.15, 0.75), []),
    ("night", "people", None, 0.1, (0.10, 0.0, 0.0), ["night_mood"]),
    ("night", "people", None, 0.4, (0.35, 0.15, 0.75), []),
    ("sunset_sunrise", "people", None, 0.5, (0.15, 0.025, 0.15), ["sunset_silhouette"]),
    ("daylight", "people", "overcast", 0.5, (0.15, 0.03, 0.20), ["uncertain_lighting"]),
    ("underexposed_daylight", "people", None, 0.5, (0.15, 0.03, 0.20), ["uncertain_lighting"]),
    ("daylight", "people", None, 0.05, (0.10, 0.02, 0.10), ["very_dark_source"]),
    ("daylight", "document_graphic", None, 0.5, (0.0, 0.0, 0.0), ["document_preserved"]),
])
def test_scene_rules(spark, lighting, subject, other, median, caps, reasons):
    flags = S.view_flags(scene_rows(spark, lighting, subject, other), "night", "sunset_sunrise", "underexposed_daylight", "document_graphic")
    row = S.scene_limits(flags, spark.createDataFrame([(1, median)], "photo long, luma_median double")).first()
    assert (row["color_strength"], row["tone_lift"], row["shadow_strength"]) == caps and row["reasons"] == reasons


def test_missing_recognition_keeps_limits(spark):
    flags = S.view_flags(scene_rows(spark, "night"), "night", "sunset_sunrise", "underexposed_daylight", "document_graphic").where("photo = 2")
    row = S.scene_limits(flags, spark.createDataFrame([(1, 0.5)], "photo long, luma_median double")).first()
    assert row["status"] == "recognition_fallback" and row["color_strength"] == 0.35


def test_tiles_round_trip(spark):
    a = np.random.default_rng(1).integers(0, 256, (37, 29, 3))
    df = image(spark, a)
    assert (back(E.explode_tiles(E.pack_tiles(df, rows=16, cols=8))) == a).all()
    assert E.pack_tiles(df, rows=16, cols=8).count() == 12


def test_median_matches_numpy(spark):
    a = np.random.default_rng(6).integers(0, 256, (9, 7, 3))
    out = back(E.median3(image(spark, a), ["r", "g", "b"]), ("r_med", "g_med", "b_med"))
    p = np.pad(a, ((1, 1), (1, 1), (0, 0)), mode="edge")
    want = np.median([p[i:i + 9, j:j + 7] for i in range(3) for j in range(3)], axis=0)
    assert (out == want).all()
