"""Pixel statistics, hashes, tone and color jobs and guards against their SQL twins."""

from pyspark.sql import functions as F

from photospark.checks.registry import check
from photospark.functions import color as K
from photospark.operators import adjust as A
from photospark.operators import features as E
from photospark.operators import resample as R
from photospark.operators import tiles as T


def d(c):
    return f"CAST({c} AS DOUBLE)"


def u(c):
    return f"(CAST({c} AS DOUBLE) / 255)"


def lum(r, g, b):
    return f"({r} * CAST(0.2126 AS DOUBLE) + {g} * CAST(0.7152 AS DOUBLE) + {b} * CAST(0.0722 AS DOUBLE))"


def ulum(p=""):
    return lum(u(p + "r"), u(p + "g"), u(p + "b"))


def clip(v, lo=0, hi=1):
    return f"least(greatest({v}, CAST({lo} AS DOUBLE)), CAST({hi} AS DOUBLE))"


def smooth(lo, hi, v):
    t = clip(f"(({v}) - {lo}) / CAST({hi - lo!r} AS DOUBLE)")
    return f"({t} * {t} * (3 - 2 * {t}))"


def lin(v):
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END)"


def disp(v):
    return f"(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE pow({v}, 1 / CAST(2.4 AS DOUBLE)) * 1.055 - 0.055 END)"


def fcode(v):
    return f"CAST(floor({clip(v)} * 255 + CAST(0.5 AS DOUBLE)) AS INT)"


def rcode(v):
    return f"CAST(round_even({clip(v)} * 255, 0) AS INT)"


LAB = f"lab AS (SELECT photo, y, x, {d('r')} * 110 / 255 AS L, ({d('g')} - 128) * CAST(1.2 AS DOUBLE) AS a, {d('b')} - 128 AS b FROM pixels)"
BOTH = "bp AS (SELECT p.*, q.r AS adj_r, q.g AS adj_g, q.b AS adj_b FROM pixels p JOIN proposal q USING (photo, y, x))"
DIMB = "bp AS (SELECT p.*, q.r AS adj_r, q.g AS adj_g, q.b AS adj_b FROM dim p JOIN proposal q USING (photo, y, x))"


def seen(v, name="pixels", *settings):
    """Pixel rows of a view's tiles with per-photo settings beside them."""
    return T.pixels_of(T.with_settings(v.tiles(name), *settings))


def lab(v):
    return seen(v).select("photo", "y", "x", "h", "w", (F.col("r").cast("double") * 110 / 255).alias("L"), ((F.col("g").cast("double") - 128) * 1.2).alias("a"), (F.col("b").cast("double") - 128).alias("b"))


def pair(v, name="pixels"):
    return T.with_second(v.tiles(name), v.tiles("proposal"))


def both(v, name="pixels", prefix="adj_"):
    return T.pixels_of(pair(v, name), adj=prefix)


def text(df, key="photo", col="x"):
    """Array column to position rows, so that values compare as numbers."""
    return df.select(key, F.posexplode(col).alias("pos", "v"))


# ------------------------------------------------------------------ sampling and tiles

@check("s16_tiles_round_trip", "SELECT photo, y, x, r, g, b FROM pixels", views="pixels")
def _(v):
    return E.explode_tiles(E.pack_tiles(v.pixels, rows=4, cols=8))


@check("s17_sample_grid", "SELECT photo, y, x, r FROM pixels WHERE y % 2 = 0 AND x % 2 = 0", views="pixels")
def _(v):
    return E.sample_grid(seen(v), edge=4).select("photo", "y", "x", "r")


@check("x12_area_resize", "SELECT photo, CAST(floor(y / 4) AS INT) AS y, CAST(floor(x / 4) AS INT) AS x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY 1, 2, 3", views="pixels", doubles="r g b")
def _(v):
    return E.area_resize(seen(v), 2)


@check("x11_patches", """SELECT photo, patch, CAST(y - py AS INT) AS y, CAST(x - px AS INT) AS x, r, g, b FROM pixels, (VALUES (0, 0, 0), (1, 0, 5), (2, 5, 0), (3, 5, 5), (4, 2, 2)) s(patch, py, px)
    WHERE y >= py AND y < py + 3 AND x >= px AND x < px + 3""", views="pixels")
def _(v):
    return E.patches(seen(v), 3)


# ------------------------------------------------------------------ lab features

def hist_sql(i, c, lo, hi):
    return f"SELECT photo, {i * 32} + CAST(least(31, floor((least(greatest({c}, {lo}), {hi}) - {lo}) / {hi - lo} * 32)) AS INT) AS pos FROM lab"


HIST = f"""cells AS ({hist_sql(0, 'L', 0, 100)} UNION ALL {hist_sql(1, 'a', -128, 128)} UNION ALL {hist_sql(2, 'b', -128, 128)}),
    hist AS (SELECT p.photo, CAST(i AS INT) AS pos, coalesce(n, 0) / CAST(64 AS DOUBLE) AS v FROM (SELECT DISTINCT photo FROM lab) p CROSS JOIN range(96) t(i)
      LEFT JOIN (SELECT photo, pos, count(*) AS n FROM cells GROUP BY photo, pos) c ON c.photo = p.photo AND c.pos = i)"""


def moments_sql(name, label, base):
    parts = []
    for part in range(3):
        for k, (fn, off) in enumerate((("avg", 0), ("stddev_pop", 3))):
            for i, c in enumerate(("L", "a", "b")):
                parts.append(f"SELECT photo, {base + part * 6 + off + i} AS pos, coalesce({fn}({c}) FILTER (WHERE {label} = {part}), 0) AS v FROM lab GROUP BY photo")
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


THIRD = "CASE WHEN y < 3 THEN 0 WHEN y < 6 THEN 1 ELSE 2 END"
ZONE = "CASE WHEN L <= 33.3 THEN 0 WHEN L <= 66.7 THEN 1 ELSE 2 END"


@check("a8_channel_histogram", f"WITH {LAB}, {HIST} SELECT photo, pos, v FROM hist", views="pixels", doubles="v")
def _(v):
    return text(E.channel_histogram(lab(v)), col="hist")


@check("a9_third_stats", f"WITH {LAB}, {moments_sql('m', THIRD, 0)} SELECT photo, pos, v FROM m", views="pixels", doubles="v")
def _(v):
    return text(E.third_stats(lab(v)), col="thirds")


@check("a10_zone_stats", f"WITH {LAB}, {moments_sql('m', ZONE, 0)} SELECT photo, pos, v FROM m", views="pixels", doubles="v")
def _(v):
    return text(E.zone_stats(lab(v)), col="zones")


@check("a11_features_132", f"WITH {LAB}, {HIST}, {moments_sql('t', THIRD, 96)}, {moments_sql('z', ZONE, 114)} SELECT photo, pos, v FROM hist UNION ALL SELECT photo, pos, v FROM t UNION ALL SELECT photo, pos, v FROM z", views="pixels", doubles="v")
def _(v):
    return text(E.features_132(lab(v)))


@check("a12_outside_fraction", f"""WITH {LAB} SELECT photo, avg(CASE WHEN L < 0 OR L > 100 THEN 1.0 ELSE 0.0 END) AS "outside_L", avg(CASE WHEN a < -128 OR a > 128 THEN 1.0 ELSE 0.0 END) AS outside_a, avg(CASE WHEN b < -128 OR b > 128 THEN 1.0 ELSE 0.0 END) AS outside_b FROM lab GROUP BY photo""", views="pixels", doubles='"outside_L" outside_a outside_b')
def _(v):
    return E.outside_fraction(lab(v))


# ------------------------------------------------------------------ rgb features

@check("a13_features_19", f"""
    WITH q AS (SELECT photo, {u('r')} AS r, {u('g')} AS g, {u('b')} AS b, {ulum()} AS l FROM pixels),
    s AS (SELECT photo, avg(r) AS a0, avg(g) AS a1, avg(b) AS a2, stddev_pop(r) AS a3, stddev_pop(g) AS a4, stddev_pop(b) AS a5, quantile_cont(l, 0.1) AS a6, quantile_cont(l, 0.25) AS a7,
      quantile_cont(l, 0.5) AS a8, quantile_cont(l, 0.75) AS a9, quantile_cont(l, 0.9) AS a10, {", ".join(f"avg(CASE WHEN least(7, floor({clip('l')} * 8)) = {i} THEN 1.0 ELSE 0.0 END) AS a{11 + i}" for i in range(8))} FROM q GROUP BY photo)
    SELECT photo, CAST(pos AS INT) AS pos, v FROM (SELECT photo, unnest([{", ".join(f"a{i}" for i in range(19))}]) AS v, unnest(range(19)) AS pos FROM s) e""", views="pixels", doubles="v")
def _(v):
    return text(E.features_19(seen(v)))


# cubic weights of 8 source positions for 128 target positions, then both axes with codes in between
REDUCED = """wts AS (SELECT o, i, CASE WHEN k < 0 THEN ceil(k * 4194304 - CAST(0.5 AS DOUBLE)) ELSE floor(k * 4194304 + CAST(0.5 AS DOUBLE)) END AS wt FROM (SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS k FROM (
      SELECT o, i, CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN ((-0.5 * t + 2.5) * t - 4) * t + 2 ELSE 0 END AS k FROM (
      SELECT o, i, abs(CAST(i AS DOUBLE) - (CAST(o AS DOUBLE) + 0.5) / 16 + 0.5) AS t FROM range(128) a(o), range(8) b(i)) q) q) q),
    wide AS (SELECT photo, y, o AS x, """ + ", ".join(f"least(greatest(floor((sum({c} * wt) + 2097152) / 4194304), 0), 255) AS {c}" for c in "rgb") + """ FROM dim JOIN wts ON i = x GROUP BY photo, y, o),
    small AS (SELECT photo, o AS y, x, """ + ", ".join(f"least(greatest(floor((sum({c} * wt) + 2097152) / 4194304), 0), 255) AS {c}" for c in "rgb") + """ FROM wide JOIN wts ON i = y GROUP BY photo, o, x)"""
RECIPE = f"""{REDUCED}, rec AS (SELECT photo, quantile_cont(l, 0.5) AS median, quantile_cont(l, 0.95) AS p95 FROM (SELECT photo, {lum(lin(u('r')), lin(u('g')), lin(u('b')))} AS l FROM small) q GROUP BY photo),
    recipes AS (SELECT photo, median, p95, CASE WHEN median >= 0.025 AND median < 0.25 AND p95 < 0.9 THEN 'natural' ELSE 'unchanged' END AS recipe FROM rec)"""


@check("a14_select_recipe", f"WITH {RECIPE} SELECT * FROM recipes", views="dim", doubles="median p95")
def _(v):
    return R.recipe_tiles(v.tiles("dim"))


def moved_sql():
    return "greatest(" + ", ".join(f"abs(({u('adj_' + c)} - {ulum('adj_')}) - ({u(c)} - {ulum()}))" for c in "rgb") + ")"


SETTINGS = f"""st AS (SELECT photo, quantile_cont(m, 0.95) AS p95, quantile_cont(l, 0.3) AS q30 FROM (SELECT photo, {moved_sql()} AS m, {ulum()} AS l FROM bp) q GROUP BY photo),
    settings AS (SELECT photo, p95 AS color_change_p95, q30 AS luma_q30, least(0.35, 0.04 / greatest(p95, CAST(0.04 AS DOUBLE))) AS color_strength, {clip('(0.35 - q30) / 0.25')} * 0.15 AS tone_lift FROM st)"""


@check("a15_natural_settings", f"WITH {BOTH}, {SETTINGS} SELECT * FROM settings", views="pixels proposal", doubles="color_change_p95 luma_q30 color_strength tone_lift")
def _(v):
    return E.natural_settings(both(v))


SHADOW = f"""sh AS (SELECT photo, quantile_cont(l, 0.3) AS luma_q30, avg(CASE WHEN l >= 0.02 AND l < 0.35 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS shadow_fraction FROM (SELECT photo, {ulum()} AS l FROM dim) q GROUP BY photo),
    shadow AS (SELECT photo, luma_q30, shadow_fraction, round_even({clip('(0.4 - luma_q30) / CAST(0.3 AS DOUBLE)')} * 75 * least(1, shadow_fraction / 0.25) / 5, 0) * 5 / 100 AS suggested_strength FROM sh)"""


@check("a16_shadow_settings", f"WITH {SHADOW} SELECT * FROM shadow", views="dim", doubles="luma_q30 shadow_fraction suggested_strength")
def _(v):
    return E.shadow_settings(seen(v, "dim"))


def codes(p=""):
    return lum(d(p + "r"), d(p + "g"), d(p + "b"))


@check("a49_luma_summary", f"SELECT photo, avg(l) AS luma_mean, quantile_cont(l, 0.1) AS q10, quantile_cont(l, 0.3) AS q30, quantile_cont(l, 0.9) AS q90 FROM (SELECT photo, {codes()} AS l FROM pixels) q GROUP BY photo", views="pixels", doubles="luma_mean q10 q30 q90")
def _(v):
    return E.luma_summary(E.sample_grid(seen(v), 512))


@check("a49_mean_change", f"WITH {BOTH} SELECT photo, (avg(abs(adj_r - r)) + avg(abs(adj_g - g)) + avg(abs(adj_b - b))) / 3 AS mean_change FROM bp GROUP BY photo", views="pixels proposal", doubles="mean_change")
def _(v):
    return E.mean_change(both(v))


@check("a47_region_stats", f"""SELECT photo, region, avg(l) AS luma_mean, quantile_cont(l, 0.5) AS luma_median FROM (SELECT photo, region, {codes()} AS l FROM pixels,
    (VALUES ('sky', 0, 0.5, 0, 1), ('center', 0.25, 0.75, 0.25, 0.75)) b(region, y0, y1, x0, x1) WHERE y / CAST(8 AS DOUBLE) >= y0 AND y / CAST(8 AS DOUBLE) < y1 AND x / CAST(8 AS DOUBLE) >= x0 AND x / CAST(8 AS DOUBLE) < x1) q GROUP BY photo, region""", views="pixels", doubles="luma_mean luma_median")
def _(v):
    return E.region_stats(seen(v), [("sky", 0, 0.5, 0, 1), ("center", 0.25, 0.75, 0.25, 0.75)])


@check("a48_dark_stats", f"""WITH {DIMB} SELECT photo, coalesce(avg(k), -1) AS dark_mean, coalesce(stddev_pop(k), -1) AS dark_std, coalesce(quantile_cont(k, 0.05), -1) AS dark_p05, coalesce(avg(m), -1) AS dim_rgb_mean FROM (
    SELECT photo, CASE WHEN {codes()} < 40 THEN {codes('adj_')} END AS k, CASE WHEN greatest({u('r')}, {u('g')}, {u('b')}) < 0.3 THEN (adj_r + adj_g + adj_b) / CAST(3 AS DOUBLE) END AS m FROM bp) q GROUP BY photo""",
       views="dim proposal", doubles="dark_mean dark_std dark_p05 dim_rgb_mean")
def _(v):
    return E.dark_stats(both(v, "dim")).fillna(-1.0)


# ------------------------------------------------------------------ image errors

TRI = """tri AS (SELECT p.photo, p.y, p.x, p.r AS src_r, p.g AS src_g, p.b AS src_b, q.r AS out_r, q.g AS out_g, q.b AS out_b, p.g AS ref_r, p.b AS ref_g, p.r AS ref_b FROM dim p JOIN proposal q USING (photo, y, x))"""


def triple(v):
    j = both(v, "dim")
    return j.select("photo", "y", "x", *[F.col(c).alias("src_" + c) for c in "rgb"], *[F.col("adj_" + c).alias("out_" + c) for c in "rgb"],
                    F.col("g").alias("ref_r"), F.col("b").alias("ref_g"), F.col("r").alias("ref_b"))


MSE = "(" + " + ".join(f"pow({u('out_' + c)} - {u('ref_' + c)}, 2)" for c in "rgb") + ") / 3"
NEWFULL = "CASE WHEN greatest(out_r, out_g, out_b) = 255 AND greatest(src_r, src_g, src_b) < 255 THEN 1.0 ELSE 0.0 END"
IMG = f"img AS (SELECT photo, avg({MSE}) AS mse, avg(({u('out_r')} + {u('out_g')} + {u('out_b')}) / 3) AS mean_rgb, avg({NEWFULL}) AS new_full_channel_fraction FROM tri GROUP BY photo)"


@check("a25_image_metrics", f"WITH {TRI}, {IMG} SELECT photo, mse, mean_rgb, new_full_channel_fraction, -10 * log10(greatest(mse, 1e-15)) AS psnr_db FROM img", views="dim proposal", doubles="mse mean_rgb new_full_channel_fraction psnr_db")
def _(v):
    return E.image_metrics(triple(v))


def median_sql(c):
    cells = ", ".join(f"(SELECT n.out_{c} FROM tri n WHERE n.photo = t.photo AND n.y = least(7, greatest(0, t.y + {dy})) AND n.x = least(7, greatest(0, t.x + {dx})))" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f"list_sort([{cells}])[5]"


NEIGH = """nb AS (SELECT t.photo, t.y, t.x, quantile_disc(n.out_r, 0.5) AS mr, quantile_disc(n.out_g, 0.5) AS mg, quantile_disc(n.out_b, 0.5) AS mb
      FROM tri t CROSS JOIN (VALUES (-1), (0), (1)) dy(a) CROSS JOIN (VALUES (-1), (0), (1)) dx(b)
      JOIN tri n ON n.photo = t.photo AND n.y = least(7, greatest(0, t.y + a)) AND n.x = least(7, greatest(0, t.x + b)) GROUP BY t.photo, t.y, t.x)"""


@check("a26_native_metrics", f"""WITH {TRI}, {IMG}, {NEIGH}, l AS (SELECT *, {ulum('out_')} AS lo, {ulum('ref_')} AS lr FROM tri),
    gr AS (SELECT *, lo - lag(lo) OVER wx AS odx, lr - lag(lr) OVER wx AS rdx, lo - lag(lo) OVER wy AS ody, lr - lag(lr) OVER wy AS rdy FROM l WINDOW wx AS (PARTITION BY photo, y ORDER BY x), wy AS (PARTITION BY photo, x ORDER BY y))
    SELECT photo, mse, mean_rgb, new_full_channel_fraction, -10 * log10(greatest(mse, 1e-15)) AS psnr_db, chroma_mse, luma_gradient_l1, coalesce(res, -1) AS dark_median_residual_codes FROM img JOIN (
      SELECT photo, avg(({" + ".join(f"pow(({u('out_' + c)} - lo) - ({u('ref_' + c)} - lr), 2)" for c in "rgb")}) / 3) AS chroma_mse, (avg(abs(ody - rdy)) + avg(abs(odx - rdx))) / 2 AS luma_gradient_l1,
        avg(CASE WHEN greatest(src_r, src_g, src_b) > 0 AND greatest(src_r, src_g, src_b) <= 16 THEN (abs(out_r - mr) + abs(out_g - mg) + abs(out_b - mb)) / CAST(3 AS DOUBLE) END) AS res
      FROM gr JOIN nb USING (photo, y, x) GROUP BY photo) e USING (photo)""", views="dim proposal", doubles="mse mean_rgb new_full_channel_fraction psnr_db chroma_mse luma_gradient_l1 dark_median_residual_codes")
def _(v):
    three = pair(v, "dim").withColumnRenamed("adj", "out").withColumn("ref", F.transform("px", lambda c: T.code(T.channel(c, 1), T.channel(c, 2), T.channel(c, 0))))
    return T.native_metrics_tiles(three, 4, 8).fillna(-1.0)


@check("w10_gradients", "SELECT photo, y, x, coalesce(r - lag(r) OVER (PARTITION BY photo, y ORDER BY x), -999) AS dx, coalesce(r - lag(r) OVER (PARTITION BY photo, x ORDER BY y), -999) AS dy FROM pixels", views="pixels")
def _(v):
    return T.gradients_tiles(v.tiles(), 4, 8).select("photo", "y", "x", F.coalesce("dx_r", F.lit(-999)).alias("dx"), F.coalesce("dy_r", F.lit(-999)).alias("dy"))


@check("a28_pooled_reference_mae", f"""WITH c AS (SELECT photo, CAST(floor(y / 2) AS INT) AS cy, CAST(floor(x / 2) AS INT) AS cx, avg(p.r) - avg(q.r) AS dr, avg(p.g) - avg(q.g) AS dg, avg(p.b) - avg(q.b) AS db FROM pixels p JOIN proposal q USING (photo, y, x) GROUP BY 1, 2, 3)
    SELECT photo, pooled_rgb_reference_mae, display_luma_mean, display_luma_q30 FROM (SELECT photo, (avg(abs(dr)) + avg(abs(dg)) + avg(abs(db))) / 3 / 255 AS pooled_rgb_reference_mae FROM c GROUP BY photo) a
    JOIN (SELECT photo, avg(l) AS display_luma_mean, quantile_cont(l, 0.3) AS display_luma_q30 FROM (SELECT photo, {ulum()} AS l FROM pixels) q GROUP BY photo) b USING (photo)""", views="pixels proposal", doubles="pooled_rgb_reference_mae display_luma_mean display_luma_q30")
def _(v):
    return E.pooled_reference_mae(v.pixels, v.proposal, 4)


# ------------------------------------------------------------------ hashes

GRID9 = "grid AS (SELECT vec_id AS photo, CAST(i // 9 AS INT) AS y, CAST(i % 9 AS INT) AS x, CAST(@elem(embedding, i % 64) AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 72)) AS i FROM embeddings) q)"


@check("f12_dhash", f"WITH {GRID9} SELECT a.photo, bit_or(CASE WHEN b.v > a.v THEN CASE WHEN a.y = 7 AND a.x = 7 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << (a.y * 8 + a.x) END ELSE CAST(0 AS BIGINT) END) AS dhash FROM grid a JOIN grid b ON b.photo = a.photo AND b.y = a.y AND b.x = a.x + 1 GROUP BY a.photo")
def _(v):
    grid = v.sql("SELECT vec_id AS photo, CAST(floor(i / 9) AS INT) AS y, CAST(i % 9 AS INT) AS x, CAST(@elem(embedding, i % 64) AS DOUBLE) AS v FROM (SELECT vec_id, embedding, explode(sequence(0, 71)) AS i FROM {embeddings}) q")
    return E.dhash(grid)


@check("f12_phash", """
    WITH px AS (SELECT photo, y, x, CAST(r AS DOUBLE) AS v FROM pixels),
    s AS (SELECT photo, k // 8 AS fy, k % 8 AS fx, sum(v * cos((2 * x + 1) * (k % 8) * pi() / 16) * cos((2 * y + 1) * (k // 8) * pi() / 16) * sqrt(CASE WHEN k % 8 = 0 THEN 1 ELSE 2 END / CAST(8 AS DOUBLE)) * sqrt(CASE WHEN k // 8 = 0 THEN 1 ELSE 2 END / CAST(8 AS DOUBLE))) AS c
      FROM px CROSS JOIN range(64) t(k) GROUP BY 1, 2, 3),
    m AS (SELECT photo, quantile_disc(c, 0.5) AS med FROM s WHERE fy + fx > 0 GROUP BY photo)
    SELECT photo, bit_or(CASE WHEN fy + fx > 0 AND c > med THEN CASE WHEN fy = 7 AND fx = 7 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(fy * 8 + fx AS INT) END ELSE CAST(0 AS BIGINT) END) AS phash FROM s JOIN m USING (photo) GROUP BY photo""", views="pixels")
def _(v):
    return E.phash(v.pixels.select("photo", "y", "x", F.col("r").cast("double").alias("v")), 8)


# ------------------------------------------------------------------ scalar color functions

MATRIX = K.wide_to_xyz_matrix()
WHITE = (K.D50_XY[0] / K.D50_XY[1], 1.0, (1 - sum(K.D50_XY)) / K.D50_XY[1])


def bend(row, white):
    t = f"(({u('r')} * CAST({row[0]!r} AS DOUBLE) + {u('g')} * CAST({row[1]!r} AS DOUBLE) + {u('b')} * CAST({row[2]!r} AS DOUBLE)) / CAST({white!r} AS DOUBLE))"
    return f"(CASE WHEN {t} > pow(6.0 / 29, 3) THEN cbrt({t}) ELSE {t} * 841 / 108 + 4.0 / 29 END)"


@check("f6_color_spaces", f"""SELECT photo, y, x, {lin(u('r'))} AS linear, {disp(lin(u('r')))} AS display, {ulum()} AS luma, 116 * fy - 16 AS lab_l, 500 * (fx - fy) AS lab_a, 200 * (fy - fz) AS lab_b
    FROM (SELECT *, {bend(MATRIX[0], WHITE[0])} AS fx, {bend(MATRIX[1], WHITE[1])} AS fy, {bend(MATRIX[2], WHITE[2])} AS fz FROM pixels) q""", views="pixels", doubles="linear display luma lab_l lab_a lab_b")
def _(v):
    r, g, b = [E.unit(c) for c in "rgb"]
    l, a, bb = K.wide_to_lab(r, g, b)
    return v.pixels.select("photo", "y", "x", K.to_linear(r).alias("linear"), K.to_display(K.to_linear(r)).alias("display"), K.luma(r, g, b).alias("luma"), l.alias("lab_l"), a.alias("lab_a"), bb.alias("lab_b"))


def shadow_sql(y, s):
    return f"({y} + {s} * 1.8 * {y} * pow(1 - {y}, 6) * {smooth(0.008, 0.045, y)} * (1 - {smooth(0.25, 0.55, y)}))"


@check("f7_f8_curves", f"""SELECT photo, y, x, {smooth(0.03, 0.25, u('r'))} AS step, {shadow_sql(u('r'), 'strength')} AS shadow, (1 - strength) * {u('r')} + strength * pow({u('r')}, gamma) AS gamma_curve,
    (1 - strength) * {u('r')} + strength * least(pow({u('r')}, gamma), 8 * {u('r')}) AS guarded FROM pixels JOIN photo_params USING (photo)""", views="pixels photo_params", doubles="step shadow gamma_curve guarded")
def _(v):
    r, s, g = E.unit("r"), F.col("strength"), F.col("gamma")
    p = v.pixels.join(v.photo_params, "photo")
    return p.select("photo", "y", "x", K.smoothstep(0.03, 0.25, r).alias("step"), K.shadow_curve(r, s).alias("shadow"), K.gamma_blend(r, g, s).alias("gamma_curve"), K.guarded_gamma_blend(r, g, s).alias("guarded"))


def skin_sql():
    cb = f"((-0.168736 * {u('r')} - 0.331264 * {u('g')} + 0.5 * {u('b')} + 0.5) * 255)"
    cr = f"((0.5 * {u('r')} - 0.418688 * {u('g')} - 0.081312 * {u('b')} + 0.5) * 255)"
    return f"({clip(f'({cb} - 70) / 15')} * {clip(f'(135 - {cb}) / 10')} * {clip(f'({cr} - 125) / 15')} * {clip(f'(185 - {cr}) / 15')})"


@check("f9_f10_skin_and_terms", f"SELECT photo, y, x, {skin_sql()} AS skin, {u('r')} + {u('g')} + {u('b')} + {u('r')} * {u('g')} + {u('r')} * {u('b')} + {u('g')} * {u('b')} + {u('r')} * {u('r')} + {u('g')} * {u('g')} + {u('b')} * {u('b')} + {u('r')} * {u('g')} * {u('b')} + 1 AS terms FROM pixels", views="pixels", doubles="skin terms")
def _(v):
    rgb = [E.unit(c) for c in "rgb"]
    terms = K.color_terms(*rgb)
    return v.pixels.select("photo", "y", "x", K.skin_weight(*rgb).alias("skin"), sum(terms[1:], terms[0]).alias("terms"))


@check("f15_rounding", f"SELECT photo, y, x, {rcode(u('r') + ' * 0.7')} AS even, {fcode(u('r') + ' * 0.7')} AS up FROM pixels", views="pixels")
def _(v):
    value = E.unit("r") * 0.7
    return v.pixels.select("photo", "y", "x", K.round_code(value).alias("even"), K.floor_code(value).alias("up"))


@check("f16_letterbox", """SELECT photo_id, fh, fw, CAST((224 - fh) // 2 AS INT) AS pad_top, CAST((224 - fw) // 2 AS INT) AS pad_left FROM (SELECT photo_id, CAST(greatest(1, round_even(h * (CAST(224 AS DOUBLE) / greatest(h, w)), 0)) AS INT) AS fh,
    CAST(greatest(1, round_even(w * (CAST(224 AS DOUBLE) / greatest(h, w)), 0)) AS INT) AS fw FROM (SELECT photo_id, 1 + photo % 4000 AS h, 1 + photo % 3001 AS w FROM photos) s) q""", views="photos")
def _(v):
    h, w = F.col("photo") % 4000 + 1, F.col("photo") % 3001 + 1
    fh, fw, t, l = K.letterbox(h, w)
    return v.photos.select("photo_id", fh.alias("fh"), fw.alias("fw"), t.alias("pad_top"), l.alias("pad_left"))


# ------------------------------------------------------------------ jobs

TONE_BASE = f"tb AS (SELECT photo, y, x, {lin(u('r'))} AS r, {lin(u('g'))} AS g, {lin(u('b'))} AS b, pow(2, exposure * strength) AS gain, recovery * strength AS rec FROM pixels JOIN photo_params USING (photo))"


@check("x1_apply_tone", f"""WITH {TONE_BASE}, t1 AS (SELECT *, greatest(r, g, b) AS peak, 0.6 / gain AS knee FROM tb),
    t2 AS (SELECT *, CASE WHEN gain <= 1 THEN gain * peak WHEN peak <= knee THEN gain * peak ELSE 0.6 + gain * greatest(peak - knee, 0) / (1 + (gain - 1) / (0.4 * (1 - knee)) * greatest(peak - knee, 0)) END AS t FROM t1),
    t3 AS (SELECT *, least(t, 0.8) + greatest(t - 0.8, 0) / (1 + rec / 100 * greatest(t - 0.8, 0) / 0.2) AS t9 FROM t2)
    SELECT photo, y, x, {clip('r * k')} AS r, {clip('g * k')} AS g, {clip('b * k')} AS b FROM (SELECT *, CASE WHEN peak > 0 THEN t9 / peak ELSE 1 END AS k FROM t3) q""", views="pixels photo_params", doubles="r g b")
def _(v):
    rows = seen(v, "pixels", v.photo_params)
    return A.apply_tone(rows.select("photo", "y", "x", "exposure", "recovery", "strength", *[K.to_linear(E.unit(c)).alias(c) for c in "rgb"]))


TOP = "CASE WHEN greatest(r, g, b) = 255 THEN 1 ELSE CAST(254 AS DOUBLE) / 255 END"


def room_sql(vals, up, down):
    return ", ".join(f"CASE WHEN {c} > 0 THEN {up.format(k=k)} / greatest({c}, CAST({{eps}} AS DOUBLE)) WHEN {c} < 0 THEN {down.format(k=k)} / greatest(-{c}, CAST({{eps}} AS DOUBLE)) ELSE 1 END" for k, c in vals)


def protect_sql(src, cs="color_strength", tl="tone_lift"):
    delta = ", ".join(f"(({u('adj_' + c)} - la) - ({u(c)} - l)) * m AS d{c}" for c in "rgb")
    lim = "least(1, 0.05 / greatest(greatest(abs(dr), abs(dg), abs(db)), CAST(1e-7 AS DOUBLE)))"
    room = room_sql([(c, f"c{c}") for c in "rgb"], "(top - ty)", "ty").replace("{eps}", "1e-7")
    return f"""pr1 AS (SELECT *, {ulum()} AS l, {ulum('adj_')} AS la, {TOP} AS top FROM {src}),
    pr2 AS (SELECT *, {cs} * ({smooth(0.03, 0.25, 'l')} * (1 - {smooth(0.75, 0.98, 'l')}) * {smooth(0.0, 0.08, f"greatest({u('r')}, {u('g')}, {u('b')}) - least({u('r')}, {u('g')}, {u('b')})")}) AS m FROM pr1),
    pr3 AS (SELECT *, {delta} FROM pr2), pr4 AS (SELECT *, {", ".join(f"{u(c)} - l + d{c} * {lim} AS c{c}" for c in "rgb")}, least(l + {tl} * l * (1 - l) * (1 - l), top) AS ty FROM pr3),
    pr5 AS (SELECT *, {clip(f"least({room})")} AS s FROM pr4), protected AS (SELECT photo, y, x, r, g, b, {", ".join(fcode(f"ty + c{c} * s") + f" AS out_{c}" for c in "rgb")} FROM pr5)"""


@check("x2_protect_color", f"WITH {BOTH}, {SETTINGS}, bs AS (SELECT bp.*, color_strength, tone_lift FROM bp JOIN settings USING (photo)), {protect_sql('bs')} SELECT * FROM protected", views="pixels proposal")
def _(v):
    return T.protect_tiles(pair(v))


GUARD = f"""guard AS (SELECT photo, count(*) FILTER (WHERE greatest(out_r, out_g, out_b) = 0 AND greatest(r, g, b) > 0) AS new_black, count(*) FILTER (WHERE greatest(out_r, out_g, out_b) = 255 AND greatest(r, g, b) < 255) AS new_full,
    least(coalesce(min(CASE WHEN {ulum()} <= 0.35 THEN {codes('out_')} - {codes()} END), 0), 0) AS shadow_delta FROM {{src}} GROUP BY photo)"""


@check("a38_endpoint_guard", "WITH pg AS (SELECT p.*, q.r AS out_r, q.g AS out_g, q.b AS out_b FROM dim p JOIN proposal q USING (photo, y, x)), " + GUARD.format(src="pg") + " SELECT *, new_black = 0 AND new_full = 0 AND shadow_delta >= -0.501 AS accepted FROM guard", views="dim proposal", doubles="shadow_delta")
def _(v):
    j = both(v, "dim", "out_")
    return A.endpoint_guard(j)


def lift_sql(src, s="strength"):
    return f"""ls1 AS (SELECT *, {ulum()} AS l FROM {src}), ls2 AS (SELECT *, least({shadow_sql('l', s)} / greatest(l, CAST(1e-7 AS DOUBLE)), {TOP} / greatest(greatest({u('r')}, {u('g')}, {u('b')}), CAST(1e-7 AS DOUBLE))) AS gn FROM ls1),
    lifted AS (SELECT photo, y, x, r, g, b, {", ".join(f"CASE WHEN {s} = 0 THEN {c} ELSE {fcode(u(c) + ' * gn')} END AS out_{c}" for c in "rgb")} FROM ls2)"""


@check("x3_lift_shadows", f"WITH dp AS (SELECT dim.*, strength FROM dim JOIN photo_params USING (photo)), {lift_sql('dp')} SELECT * FROM lifted", views="dim photo_params")
def _(v):
    return A.lift_shadows(seen(v, "dim", v.photo_params.select("photo", "strength")).drop("h", "w")).drop("strength")


def coef_value(t, i):
    base = {0: (1, 0, 0), 1: (0, 1, 0), 2: (0, 0, 1)}.get(t, (0, 0, 0))[i]
    return f"({base} + (photo % 5 - 2) * CAST({(t + 1) * (i + 2) / 500!r} AS DOUBLE))"


TERMS = ["ur", "ug", "ub", "ur * ug", "ur * ub", "ug * ub", "ur * ur", "ug * ug", "ub * ub", "ur * ug * ub", "1"]


def coefs(v):
    return v.sql("SELECT vec_id AS photo, array(" + ", ".join(coef_value(t, i).replace("photo", "vec_id") for t in range(11) for i in range(3)) + ") AS coef FROM {embeddings}")


def wb_sql(tint):
    poly = lambda i: clip(" + ".join(f"{term} * {coef_value(t, i)}" for t, term in enumerate(TERMS)))
    axis = ("1", "-(0.2126 + CAST(0.0722 AS DOUBLE)) / 0.7152", "1")
    if tint:
        along = f"((er * 1 + eg * ({axis[1]}) + eb * 1) / (2 + pow({axis[1]}, 2)))"
        final = ", ".join(f"{along} * ({a}) * 0.5 AS f{c}" for c, a in zip("rgb", axis))
    else:
        final = ", ".join(f"e{c} * 0.5 AS f{c}" for c in "rgb")
    room = ", ".join(f"CASE WHEN g{c} > 0 THEN (top - u{c}) / greatest(g{c}, CAST(1e-12 AS DOUBLE)) WHEN g{c} < 0 THEN u{c} / greatest(-g{c}, CAST(1e-12 AS DOUBLE)) ELSE 1 END" for c in "rgb")
    return f"""w1 AS (SELECT *, {", ".join(f"{u(c)} AS u{c}" for c in "rgb")}, {TOP} AS top, 0.04 - 0.015 * {skin_sql()} AS cap FROM pixels),
    w2 AS (SELECT *, {", ".join(f"{poly(i)} - u{c} AS q{c}" for i, c in enumerate("rgb"))} FROM w1),
    w3 AS (SELECT *, {", ".join(f"q{c} - {lum('qr', 'qg', 'qb')} AS e{c}" for c in "rgb")} FROM w2), w4 AS (SELECT *, {final} FROM w3),
    w5 AS (SELECT *, {", ".join(f"f{c} * least(1, cap / greatest(greatest(abs(fr), abs(fg), abs(fb)), CAST(1e-12 AS DOUBLE))) AS g{c}" for c in "rgb")} FROM w4),
    w6 AS (SELECT *, {clip(f"least({room})")} AS s FROM w5), wb AS (SELECT photo, y, x, r, g, b, {", ".join(fcode(f"u{c} + g{c} * s") + f" AS out_{c}" for c in "rgb")} FROM w6)"""


@check("x4_apply_wb", f"WITH {wb_sql(False)} SELECT * FROM wb", views="pixels")
def _(v):
    return A.apply_wb(seen(v, "pixels", coefs(v)))


@check("x4_apply_wb_tint", f"WITH {wb_sql(True)} SELECT * FROM wb", views="pixels")
def _(v):
    return A.apply_wb(seen(v, "pixels", coefs(v)), tint_only=True)


WBGUARD = """SELECT photo, count(*) FILTER (WHERE greatest(out_r, out_g, out_b) = 0 AND greatest(r, g, b) > 0) AS new_black, count(*) FILTER (WHERE greatest(out_r, out_g, out_b) = 255 AND greatest(r, g, b) < 255) AS new_full,
    max(abs(""" + lum("(out_r - r)", "(out_g - g)", "(out_b - b)") + """)) AS luma_change, CAST(max(greatest(abs(out_r - r), abs(out_g - g), abs(out_b - b))) AS DOUBLE) AS channel_change FROM wb GROUP BY photo"""


@check("x4_wb_guard", f"WITH {wb_sql(False)} SELECT *, new_black = 0 AND new_full = 0 AND luma_change <= 0.501 AND channel_change <= 10.501 AS accepted FROM ({WBGUARD}) q", views="pixels", doubles="luma_change channel_change")
def _(v):
    return A.wb_guard(A.apply_wb(seen(v, "pixels", coefs(v))))


def neutral_sql(src):
    inm = f"({ulum()} >= 0.15 AND {ulum()} <= 0.9 AND greatest({u('r')}, {u('g')}, {u('b')}) - least({u('r')}, {u('g')}, {u('b')}) <= 0.22)"
    quad = "(CASE WHEN y < 4 THEN 0 ELSE 2 END + CASE WHEN x < 4 THEN 0 ELSE 1 END)"
    return f"""n1 AS (SELECT photo, {inm} AS keep, {quad} AS quad, {", ".join(f"{u(c)} - {ulum()} AS b{c}, {u('out_' + c)} - {ulum('out_')} AS a{c}" for c in "rgb")} FROM {src}),
    n2 AS (SELECT photo, count(*) FILTER (WHERE keep) AS n, count(*) AS total, avg((abs(br) + abs(bg) + abs(bb)) / 3) FILTER (WHERE keep) AS before, avg((abs(ar) + abs(ag) + abs(ab)) / 3) FILTER (WHERE keep) AS after,
      {", ".join(f"avg(a{c} - b{c}) FILTER (WHERE keep) AS d{c}" for c in "rgb")} FROM n1 GROUP BY photo),
    n3 AS (SELECT *, sqrt(dr * dr + dg * dg + db * db) AS length FROM n2),
    q1 AS (SELECT photo, quad, {", ".join(f"avg(a{c} - b{c}) AS e{c}" for c in "rgb")} FROM n1 WHERE keep GROUP BY photo, quad HAVING count(*) >= 4),
    q2 AS (SELECT photo, count(*) AS quadrants, min((er * dr + eg * dg + eb * db) / greatest(sqrt(er * er + eg * eg + eb * eb) * length, CAST(1e-12 AS DOUBLE))) AS low FROM q1 JOIN n3 USING (photo) GROUP BY photo),
    neutral AS (SELECT photo, n, total, coalesce(before, -1) AS before, coalesce(after, -1) AS after, coalesce(length, -1) AS length, CAST(coalesce(quadrants, 0) AS INT) AS quadrants,
      CASE WHEN n < 16 OR n / total < 0.02 THEN 'insufficient_neutral_candidates' WHEN before < 0.01 OR after > before * 0.9 OR length < 0.003 THEN 'no_supported_neutral_improvement'
        WHEN coalesce(quadrants, 0) < 2 OR low < 0.5 THEN 'spatial_neutral_disagreement' ELSE '' END AS reason FROM n3 LEFT JOIN q2 USING (photo))"""


@check("a39_neutral_evidence", f"WITH {wb_sql(False)}, {neutral_sql('wb')} SELECT * FROM neutral", views="pixels", doubles="before after length")
def _(v):
    return A.neutral_evidence(A.apply_wb(seen(v, "pixels", coefs(v)), keep=("h", "w")), 16, 0.02, 4).fillna(-1.0, ["before", "after", "length"])


@check("x6_natural_adjust", f"""
    WITH {BOTH}, {SETTINGS}, lims AS (SELECT photo, least(color_strength, 0.2) AS cs, least(tone_lift, 0.1) AS tl FROM settings), bs AS (SELECT bp.*, cs, tl FROM bp JOIN lims USING (photo)), {protect_sql('bs', 'cs', 'tl')},
    bg AS (SELECT * FROM ({GUARD.format(src='protected').replace('guard AS ', '', 1)}) q), {SHADOW.replace('FROM dim)', 'FROM pixels)')},
    lp AS (SELECT photo, y, x, out_r AS r, out_g AS g, out_b AS b, least(suggested_strength, 0.5) AS strength FROM protected JOIN shadow USING (photo)), {lift_sql('lp')},
    fin AS (SELECT p.photo, p.y, p.x, p.r, p.g, p.b, l.out_r, l.out_g, l.out_b FROM pixels p JOIN lifted l USING (photo, y, x)), {GUARD.format(src='fin')}
    SELECT photo, y, x, CASE WHEN ok THEN out_r ELSE r END AS r, CASE WHEN ok THEN out_g ELSE g END AS g, CASE WHEN ok THEN out_b ELSE b END AS b FROM fin JOIN (SELECT guard.photo, guard.new_black = 0 AND guard.new_full = 0 AND bg.new_black = 0 AND bg.new_full = 0 AND bg.shadow_delta >= -0.501 AS ok FROM guard JOIN bg USING (photo)) o USING (photo)""", views="pixels proposal")
def _(v):
    limits = v.embeddings.select(F.col("vec_id").alias("photo"), F.lit(0.2).alias("color_strength"), F.lit(0.1).alias("tone_lift"), F.lit(0.5).alias("shadow_strength"))
    return T.natural_adjust_tiles(pair(v), limits)[0]


@check("x7_blend", f"WITH {BOTH} SELECT photo, y, x, {', '.join(f'CAST(round_even({d(c)} * (1 - CAST(0.3 AS DOUBLE)) + {d('adj_' + c)} * CAST(0.3 AS DOUBLE), 0) AS INT) AS {c}' for c in 'rgb')} FROM bp", views="pixels proposal")
def _(v):
    return A.blend(both(v), 0.3)


def curve_sql(value):
    return ", ".join(f"CASE WHEN strength = 0 THEN {c} ELSE {rcode(value(c))} END AS out_{c}" for c in "rgb")


@check("x8_apply_curves", f"SELECT photo, y, x, r, g, b, {curve_sql(lambda c: f'(1 - strength) * {u(c)} + strength * least(pow({u(c)}, gamma), 8 * {u(c)})')} FROM pixels JOIN photo_params USING (photo)", views="pixels photo_params")
def _(v):
    return A.apply_curves(seen(v, "pixels", v.photo_params.select("photo", "gamma", "strength")), kind="guarded")


def peak_value(c):
    peak = f"greatest({u('r')}, {u('g')}, {u('b')})"
    val = f"({u(c)} * (least(pow(greatest({peak}, CAST(1e-8 AS DOUBLE)), gamma), 8 * {peak}) / greatest({peak}, CAST(1e-8 AS DOUBLE))))"
    return f"(1 - strength) * {u(c)} + strength * ({val} + tint * {val} * (1 - {val}))"


@check("x8_apply_peak_curves", f"SELECT photo, y, x, r, g, b, {curve_sql(peak_value)} FROM pixels JOIN photo_params USING (photo)", views="pixels photo_params")
def _(v):
    return A.apply_curves(seen(v, "pixels", v.photo_params.select("photo", "gamma", "strength", "tint")), kind="peak")


@check("a37_clip_diagnostics", """SELECT photo, avg(CASE WHEN greatest(r, g, b) = 255 THEN 1.0 ELSE 0.0 END) AS before_full, avg(CASE WHEN greatest(out_r, out_g, out_b) = 255 THEN 1.0 ELSE 0.0 END) AS after_full,
    avg(CASE WHEN greatest(out_r, out_g, out_b) = 255 AND greatest(r, g, b) < 255 THEN 1.0 ELSE 0.0 END) AS new_full, avg(CASE WHEN least(r, g, b) = 255 THEN 1.0 ELSE 0.0 END) AS source_white,
    avg(CASE WHEN r <> out_r OR g <> out_g OR b <> out_b THEN 1.0 ELSE 0.0 END) AS changed FROM (SELECT p.*, q.r AS out_r, q.g AS out_g, q.b AS out_b FROM dim p JOIN proposal q USING (photo, y, x)) j GROUP BY photo""", views="dim proposal", doubles="before_full after_full new_full source_white changed")
def _(v):
    return A.clip_diagnostics(both(v, "dim", "out_"))


@check("x10_recipe_gate", f"""WITH {RECIPE}, nf AS (SELECT p.photo, avg(CASE WHEN greatest(q.r, q.g, q.b) = 255 AND greatest(p.r, p.g, p.b) < 255 THEN 1.0 ELSE 0.0 END) AS new_full FROM dim p JOIN proposal q USING (photo, y, x) GROUP BY p.photo)
    SELECT photo, recipe, CASE WHEN recipe <> 'unchanged' AND new_full > 0.001 THEN 'unchanged' ELSE recipe END AS selected, CASE WHEN recipe <> 'unchanged' AND new_full > 0.001 THEN 'candidate rejected by clipping guard' ELSE '' END AS reason FROM recipes JOIN nf USING (photo)""", views="dim proposal")
def _(v):
    diag = A.clip_diagnostics(both(v, "dim", "out_"))
    return A.recipe_gate(R.recipe_tiles(v.tiles("dim")), diag).select("photo", "recipe", "selected", "reason")


@check("x13_dark_controls", f"SELECT photo || '_dark_control' AS photo, photo AS parent, y, x, {', '.join(rcode(disp(lin(u(c)) + ' * 0.125')) + f' AS {c}' for c in 'rgb')} FROM pixels WHERE photo IN (SELECT vec_id FROM embeddings WHERE label IN (1, 2))", views="pixels")
def _(v):
    chosen = v.embeddings.where(F.col("label").isin(1, 2)).select(F.col("vec_id").alias("photo"))
    return A.dark_controls(T.pixels_of(v.tiles().join(chosen, "photo", "left_semi")))


def lut_corner(k):
    bits = [(k >> i) & 1 for i in range(3)]
    idx = [f"least(i{c} + {b}, 32)" for c, b in zip("rgb", bits)]
    w = " * ".join(f"f{c}" if b else f"(1 - f{c})" for c, b in zip("rgb", bits))
    return idx, w


def lut_value(i):
    """Weighted sum of three basis tables at an integer node, per channel."""
    out = []
    for k in range(8):
        idx, w = lut_corner(k)
        n = f"({idx[i]} / CAST(32 AS DOUBLE))"
        out.append(f"({w}) * (w0 * {n} + w1 * (1 - {n}) + w2 * {n} * {n})")
    return " + ".join(out)


@check("j20_apply_lut3d", f"""WITH p1 AS (SELECT pixels.*, 0.8 + strength / 10 AS w0, strength / 20 AS w1, tint AS w2, {", ".join(f"least({u(c)} / CAST(1.0001 AS DOUBLE) * 32, 32) AS t{c}" for c in "rgb")} FROM pixels JOIN photo_params USING (photo)),
    p2 AS (SELECT *, {", ".join(f"CAST(floor(t{c}) AS INT) AS i{c}, t{c} - floor(t{c}) AS f{c}" for c in "rgb")} FROM p1)
    SELECT photo, y, x, r, g, b, {", ".join(f"CAST(floor({clip(f'({lut_value(i)}) * 255 + CAST(0.5 AS DOUBLE)', 0, 255)}) AS INT) AS out_{c}" for i, c in enumerate("rgb"))} FROM p2""", views="pixels photo_params")
def _(v):
    n = 33
    node = v.spark.range(n ** 3).select(F.floor(F.col("id") / (n * n)).cast("int").alias("ri"), (F.floor(F.col("id") / n) % n).cast("int").alias("gi"), (F.col("id") % n).cast("int").alias("bi"))
    f = [F.col(c) / 32 for c in ("ri", "gi", "bi")]
    bases = node.withColumn("v", F.array(F.array(*f), F.array(*[F.lit(1.0) - e for e in f]), F.array(*[e * e for e in f])))
    weights = v.photo_params.select("photo", F.array(F.lit(0.8) + F.col("strength") / 10, F.col("strength") / 20, F.col("tint")).alias("weights"))
    return T.lut3d_tiles(v.tiles(), bases, weights)


@check("w11_monotone_steps", "SELECT photo, y, count(*) FILTER (WHERE d < 0) AS decreasing, count(*) AS points FROM (SELECT photo, y, r - lag(r) OVER (PARTITION BY photo, y ORDER BY x) AS d FROM pixels) q GROUP BY photo, y", views="pixels")
def _(v):
    return A.monotone_steps(v.pixels, ["photo", "y"], "x", "r")


@check("a43_fit_color_poly")
def _(v):
    fit = A.fit_color_poly(both(v))
    return fit.select("photo", "rank", F.size("coef").alias("n"))


@check("a52_crop_consistency", "SELECT count(*) FILTER (WHERE r <> r) AS different FROM pixels", views="pixels")
def _(v):
    diff = A.crop_consistency(v.pixels, lambda p: A.apply_wb(p, coefs(v)), [(0, 4, 0, 4), (2, 6, 3, 8)])
    return diff.agg(F.count(F.lit(1)).alias("different"))
