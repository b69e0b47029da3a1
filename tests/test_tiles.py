"""Tile jobs against the pixel forms and plain numpy, and their plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from photospark.operators import adjust as A
from photospark.operators import features as E
from photospark.operators import tiles as T

rng = np.random.default_rng(5)
SHAPES = {1: (11, 13), 2: (5, 7), 3: (1, 1), 4: (9, 4)}
IMAGES = {k: rng.integers(0, 256, (*s, 3)) for k, s in SHAPES.items()}
SECOND = {k: np.clip(v + rng.integers(-30, 31, v.shape), 0, 255) for k, v in IMAGES.items()}


def pixels(spark, images):
    rows = [(k, y, x, *[int(c) for c in a[y, x]]) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "photo long, y int, x int, r int, g int, b int")


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Tiles of both versions as written tables, so that plans start at a scan."""
    folder = tmp_path_factory.mktemp("tiles")
    out = []
    for name, images in (("first", IMAGES), ("second", SECOND)):
        T.cut_tiles(pixels(spark, images), 4, 5).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def same(a, b):
    cols = sorted(a.columns)
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(a) == key(b.select(*cols))


def exchanged(df):
    """Columns that cross an exchange in the plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert inputs
    return {c.split("#")[0] for line in inputs for c in line.split(", ")}


def test_tiles_give_every_pixel_back(spark, cut):
    same(T.pixels_of(cut[0]).drop("h", "w"), pixels(spark, IMAGES))
    assert {(r["photo"], r["h"], r["w"]) for r in cut[0].collect()} == {(k, *s) for k, s in SHAPES.items()}
    stored = cut[0].withColumn("rgb", F.expr("unhex(array_join(transform(px, c -> lpad(hex(c), 6, '0')), ''))"))
    same(T.from_binary(stored.select(*T.PLACE, "rows", "cols", "h", "w", "rgb")), cut[0])


def test_a_different_cut_is_refused(spark, cut):
    other = T.cut_tiles(pixels(spark, SECOND), 4, 6)
    with pytest.raises(Exception, match="cut differently"):
        T.with_second(cut[0], other).collect()


def test_empty_tiles(spark, cut):
    none = cut[0].limit(0)
    assert T.pixels_of(none).count() == 0
    assert T.protect_tiles(T.with_second(none, cut[1])).count() == 0


def test_natural_adjust_equals_the_pixel_form(spark, cut):
    limits = spark.createDataFrame([(k, 0.2, 0.1, 0.1 * k) for k in IMAGES], "photo long, color_strength double, tone_lift double, shadow_strength double")
    out, report = T.natural_adjust_tiles(T.with_second(*cut), limits)
    plain, plain_report = A.natural_adjust(pixels(spark, IMAGES), pixels(spark, SECOND), limits)
    same(out, plain)
    same(report, plain_report)
    assert not exchanged(out) & {"y", "x", "r", "g", "b", "adj_r", "out_r", "src_r"}


def test_protect_and_white_balance_shuffle_no_pixels(spark, cut):
    both = E.join_pixels(pixels(spark, IMAGES), pixels(spark, SECOND))
    out = T.protect_tiles(T.with_second(*cut))
    same(out, A.protect_color(both, E.natural_settings(both)))
    coefs = spark.createDataFrame([(k, rng.normal(0.3, 0.2, 33).tolist()) for k in IMAGES], "photo long, coef array<double>")
    balanced = A.apply_wb(T.pixels_of(T.with_settings(cut[0], coefs)))
    same(balanced, A.apply_wb(pixels(spark, IMAGES), coefs))
    lab = T.pixels_of(cut[0]).select("photo", "y", "x", "h", "w", F.col("r").alias("L"), F.col("g").alias("a"), F.col("b").alias("b"))
    for df in (out, balanced, E.features_132(lab)):
        assert not exchanged(df) & {"y", "x", "r", "g", "b", "L", "a", "adj_r", "out_r"}


def test_histogram_and_moments_in_one_pass(spark, cut):
    lab = T.pixels_of(cut[0]).select("photo", "y", "x", "h", "w", (F.col("r") / 2.55).alias("L"), (F.col("g") - 128.0).alias("a"), (F.col("b") - 128.0).alias("b"))
    got = {r["photo"]: np.array(r["x"]) for r in E.features_132(lab).collect()}
    for photo, a in IMAGES.items():
        values = [a[..., 0] / 2.55, a[..., 1] - 128.0, a[..., 2] - 128.0]
        hist = np.concatenate([np.histogram(np.clip(v, lo, hi), 32, (lo, hi))[0] for v, (lo, hi) in zip(values, E.LAB_BOUNDS.values())]) / a[..., 0].size
        assert np.allclose(got[photo][:96], hist)
        parts = []
        for part in np.array_split(np.arange(a.shape[0]), 3):
            parts += [v[part].mean() if len(part) else 0 for v in values] + [v[part].std() if len(part) else 0 for v in values]
        assert np.allclose(got[photo][96:114], parts)


def test_lookup_table_on_tiles(spark, cut):
    n, count = 5, 3
    table = rng.random((n, n, n, count, 3))
    rows = [(i, j, k, table[i, j, k].tolist()) for i in range(n) for j in range(n) for k in range(n)]
    bases = spark.createDataFrame(rows, "ri int, gi int, bi int, v array<array<double>>")
    weights = spark.createDataFrame([(k, [0.5, 0.3, 0.1 * k]) for k in IMAGES], "photo long, weights array<double>")
    out = T.lut3d_tiles(cut[0], bases, weights, n, count)
    same(out, A.apply_lut3d(pixels(spark, IMAGES), bases, weights, n, count))
    assert not exchanged(out) & {"y", "x", "r", "out_r"}
    with pytest.raises(ValueError, match="every node"):
        T.lut3d_tiles(cut[0], bases.where("ri > 0"), weights, n, count)
    with pytest.raises(ValueError, match="every node"):
        T.lut3d_tiles(cut[0], bases.unionByName(bases.where("ri = 0 AND gi = 0 AND bi = 0")), weights, n, count)


def test_borders_make_cut_photos_equal_to_whole_ones(spark, cut):
    first, second = cut
    three = T.with_second(first, second, "out").withColumn("ref", F.transform("px", lambda c: T.code(T.channel(c, 1), T.channel(c, 2), T.channel(c, 0))))
    three = three.withColumn("px", F.transform("px", lambda c: T.code(T.channel(c, 0) % 20, T.channel(c, 1) % 20, T.channel(c, 2) % 20)))
    rows = T.pixels_of(three, out="out_", ref="ref_").withColumnsRenamed({c: "src_" + c for c in "rgb"})
    plain = {r["photo"]: r.asDict() for r in E.native_metrics(rows).collect()}
    got = {r["photo"]: r.asDict() for r in T.native_metrics_tiles(three, 4, 5).collect()}
    assert set(got) == set(plain) == set(IMAGES)
    for photo, values in got.items():
        for name, value in values.items():
            want = plain[photo][name]
            assert (value is None and want is None) or np.isclose(value, want, atol=1e-12), (photo, name, value, want)


def test_gradients_across_tiles(spark, cut):
    df = T.gradients_tiles(cut[0], 4, 5)
    got = {(r["photo"], r["y"], r["x"]): (r["dx_g"], r["dy_g"]) for r in df.collect()}
    for photo, a in IMAGES.items():
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                want = (a[y, x, 1] - a[y, x - 1, 1] if x else None, a[y, x, 1] - a[y - 1, x, 1] if y else None)
                assert got[photo, y, x] == want
    with pytest.raises(Exception, match="pitch"):
        T.gradients_tiles(cut[0], 4, 6).collect()


def resized(a, height, width):
    """Plain two-axis cubic resampling with codes in between, pixel by pixel."""
    def axis(v, size, target):
        scale = size / target
        wide, out = max(scale, 1.0), []
        for o in range(target):
            center = (o + 0.5) * scale
            at = range(max(int(center - 2 * wide + 0.5), 0), min(int(center + 2 * wide + 0.5), size))
            raw = []
            for i in at:
                t = abs((i - center + 0.5) / wide)
                raw.append(1.5 * t ** 3 - 2.5 * t ** 2 + 1 if t < 1 else -0.5 * t ** 3 + 2.5 * t ** 2 - 4 * t + 2 if t < 2 else 0.0)
            whole = [int(np.trunc(k / sum(raw) * 2 ** 22 + np.copysign(0.5, k))) for k in raw]
            out.append(sum(v[i].astype(int) * k for i, k in zip(at, whole)))
        return np.clip((np.stack(out) + 2 ** 21) >> 22, 0, 255)

    across = axis(a.transpose(1, 0, 2), a.shape[1], width)
    return axis(across.transpose(1, 0, 2), a.shape[0], height)


@pytest.mark.parametrize("size", [(4, 3), (16, 20), (7, 7)])
def test_resampling_to_any_size(spark, cut, size):
    from photospark.operators.resample import resize_tiles

    df = resize_tiles(cut[0], *size)
    got = {(r["photo"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in df.collect()}
    assert len(got) == len(IMAGES) * size[0] * size[1]
    for photo, a in IMAGES.items():
        want = resized(a, *size)
        for y in range(size[0]):
            for x in range(size[1]):
                assert got[photo, y, x] == tuple(want[y, x]), (photo, y, x)


def test_resampling_to_the_same_size_changes_nothing(spark, cut):
    from photospark.operators.resample import resize_tiles

    same(resize_tiles(cut[0].where("photo = 1"), *SHAPES[1]), pixels(spark, {1: IMAGES[1]}))
