"""Pointwise tone and color jobs over pixel tables, their guards and decisions.

Settings are one row per photo and join on the photo; the maps themselves are column expressions. Rows that carry
their settings already, as those of ``tiles.pixels_of`` do, need no settings table and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.functions import color as K
from photospark.operators.features import RGB, new_full, unit, unit_luma
from photospark.session import sound_unions

HEADROOM = 254 / 255
# Per-photo caps of color strength and tone lift, and the largest shadow strength.
CAPS = {"color_strength": 0.35, "tone_lift": 0.15, "shadow_strength": 0.75}


def _ceiling() -> Column:
    """Highest allowed value: full only where the source already has a full channel."""
    return F.when(F.greatest(*[F.col(c) for c in RGB]) == 255, 1.0).otherwise(HEADROOM)


def _with(rows: DataFrame, settings: DataFrame | None, *cols: str) -> DataFrame:
    """Rows with the settings of their photo; without a table they carry them already."""
    return rows if settings is None else rows.join(settings.select("photo", *cols), "photo")


def apply_tone(linear: DataFrame, params: DataFrame | None = None, protect: bool = True) -> DataFrame:
    """Exposure with a highlight shoulder and highlight recovery on linear r, g, b in [0,1].

    ``params``: (photo, exposure, recovery, strength).
    """
    p = _with(linear, params, "exposure", "recovery", "strength")
    p = p.withColumn("_gain", F.pow(F.lit(2.0), F.col("exposure") * F.col("strength"))).withColumn("_peak", F.greatest(*RGB))
    knee = F.lit(0.6) / F.col("_gain")
    over = F.greatest(F.col("_peak") - knee, F.lit(0.0))
    shoulder = (F.col("_gain") - 1) / ((F.lit(1.0) - knee) * 0.4)
    curved = F.when(F.col("_peak") <= knee, F.col("_gain") * F.col("_peak")).otherwise(F.col("_gain") * over / (F.lit(1.0) + shoulder * over) + 0.6)
    plain = F.col("_gain") * F.col("_peak")
    target = F.when(F.col("_gain") > 1, curved).otherwise(plain) if protect else plain
    p = p.withColumn("_t", target)
    high = F.greatest(F.col("_t") - 0.8, F.lit(0.0))
    squeezed = F.least("_t", F.lit(0.8)) + high / (F.lit(1.0) + F.col("recovery") * F.col("strength") / 100 * high / 0.2)
    p = p.withColumn("_k", F.when(F.col("_peak") > 0, squeezed / F.col("_peak")).otherwise(1.0))
    return p.select("photo", "y", "x", *[K.clamp(F.col(c) * F.col("_k")).alias(c) for c in RGB])


def capped(settings: DataFrame, caps: DataFrame) -> DataFrame:
    """(photo, color_strength, tone_lift), both lowered to the photo's caps where it has some."""
    c = caps.select("photo", F.col("color_strength").alias("_cc"), F.col("tone_lift").alias("_ct"))
    return settings.join(c, "photo", "left").select("photo", F.least("color_strength", "_cc").alias("color_strength"), F.least("tone_lift", "_ct").alias("tone_lift"))


def protect_color(both: DataFrame, settings: DataFrame | None = None, caps: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Merge original (r,g,b) and proposed (adj_*) pixels into bounded out_* pixels.

    ``settings``: (photo, color_strength, tone_lift); ``caps`` lowers both per photo; ``keep`` names further columns to carry.
    """
    if settings is not None and caps is not None:
        settings = capped(settings, caps)
    p = _with(both, settings, "color_strength", "tone_lift").withColumn("_y", unit_luma()).withColumn("_ya", unit_luma("adj_"))
    spread = F.greatest(*[unit(c) for c in RGB]) - F.least(*[unit(c) for c in RGB])
    y = F.col("_y")
    mask = K.smoothstep(0.03, 0.25, y) * (F.lit(1.0) - K.smoothstep(0.75, 0.98, y)) * K.smoothstep(0.0, 0.08, spread)
    p = p.withColumn("_m", F.col("color_strength") * mask)
    p = p.withColumns({f"_d{c}": ((unit("adj_" + c) - F.col("_ya")) - (unit(c) - y)) * F.col("_m") for c in RGB})
    limit = F.least(F.lit(1.0), F.lit(0.05) / F.greatest(F.greatest(*[F.abs(f"_d{c}") for c in RGB]), F.lit(1e-7)))
    p = p.withColumn("_l", limit).withColumns({f"_c{c}": unit(c) - y + F.col(f"_d{c}") * F.col("_l") for c in RGB})
    top = _ceiling()
    p = p.withColumn("_top", top).withColumn("_ty", F.least(y + F.col("tone_lift") * y * (F.lit(1.0) - y) * (F.lit(1.0) - y), F.col("_top")))
    room = [
        F.when(F.col(f"_c{c}") > 0, (F.col("_top") - F.col("_ty")) / F.greatest(F.col(f"_c{c}"), F.lit(1e-7)))
        .when(F.col(f"_c{c}") < 0, F.col("_ty") / F.greatest(-F.col(f"_c{c}"), F.lit(1e-7))).otherwise(1.0) for c in RGB
    ]
    p = p.withColumn("_s", K.clamp(F.least(*room)))
    return p.select("photo", "y", "x", *keep, *RGB, *[K.floor_code(F.col("_ty") + F.col(f"_c{c}") * F.col("_s")).alias("out_" + c) for c in RGB])


def lift_shadows(pixels: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """Common-gain shadow lift with headroom into out_*; strength 0 keeps the pixels. ``strengths``: (photo, strength)."""
    p = _with(pixels, strengths, "strength").withColumn("_y", unit_luma())
    target = K.shadow_curve(F.col("_y"), F.col("strength"))
    peak = F.greatest(*[unit(c) for c in RGB])
    gain = F.least(target / F.greatest("_y", F.lit(1e-7)), _ceiling() / F.greatest(peak, F.lit(1e-7)))
    p = p.withColumn("_g", gain)
    return p.select(*pixels.columns, *[F.when(F.col("strength") == 0, F.col(c)).otherwise(K.floor_code(unit(c) * F.col("_g"))).alias("out_" + c) for c in RGB])


def apply_wb(pixels: DataFrame, coefficients: DataFrame | None = None, tint_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bounded white-balance map. ``coefficients``: (photo, coef) with 33 values, term-major (11 terms x r,g,b); ``keep``: columns to carry."""
    p = _with(pixels, coefficients, "coef")
    p = p.withColumns({f"_u{c}": unit(c) for c in RGB})
    u = [F.col(f"_u{c}") for c in RGB]
    terms = K.color_terms(*u)
    mapped = {f"_q{c}": K.clamp(sum((terms[t] * F.col("coef")[t * 3 + i] for t in range(1, 11)), terms[0] * F.col("coef")[i])) - u[i] for i, c in enumerate(RGB)}
    p = p.withColumns(mapped)
    p = p.withColumn("_ql", K.luma(*[F.col(f"_q{c}") for c in RGB]))
    p = p.withColumns({f"_d{c}": F.col(f"_q{c}") - F.col("_ql") for c in RGB})
    if tint_only:
        axis = (1.0, -(K.LUMA[0] + K.LUMA[2]) / K.LUMA[1], 1.0)
        length = sum(a * a for a in axis)
        p = p.withColumn("_along", sum((F.col(f"_d{c}") * a for c, a in zip(RGB[1:], axis[1:])), F.col("_dr") * axis[0]) / length)
        p = p.withColumns({f"_d{c}": F.col("_along") * a for c, a in zip(RGB, axis)})
    cap = F.lit(0.04) - K.skin_weight(*u) * 0.015
    biggest = F.greatest(*[F.abs(F.col(f"_d{c}") * 0.5) for c in RGB])
    p = p.withColumn("_k", F.least(F.lit(1.0), cap / F.greatest(biggest, F.lit(1e-12))) * 0.5).withColumns({f"_e{c}": F.col(f"_d{c}") * F.col("_k") for c in RGB})
    top = _ceiling()
    room = [
        F.when(F.col(f"_e{c}") > 0, (top - F.col(f"_u{c}")) / F.greatest(F.col(f"_e{c}"), F.lit(1e-12)))
        .when(F.col(f"_e{c}") < 0, F.col(f"_u{c}") / F.greatest(-F.col(f"_e{c}"), F.lit(1e-12))).otherwise(1.0) for c in RGB
    ]
    p = p.withColumn("_s", K.clamp(F.least(*room)))
    return p.select("photo", "y", "x", *keep, *RGB, *[K.floor_code(F.col(f"_u{c}") + F.col(f"_e{c}") * F.col("_s")).alias("out_" + c) for c in RGB])


def blend(both: DataFrame, strength: float) -> DataFrame:
    """Original and adjusted pixels mixed by strength, rounded half to even."""
    return both.select("photo", "y", "x", *[
        F.rint(F.col(c).cast("double") * (1 - strength) + F.col("adj_" + c).cast("double") * strength).cast("int").alias(c) for c in RGB])


def apply_curves(pixels: DataFrame, curves: DataFrame | None = None, kind: str = "gamma") -> DataFrame:
    """Gamma, guarded gamma or shared-peak curve per photo.

    ``curves``: (photo, gamma, strength) and, for ``peak``, (tint) added to every channel's chroma term.
    """
    p = pixels if curves is None else pixels.join(curves, "photo")
    g, s = F.col("gamma"), F.col("strength")
    if kind == "peak":
        peak = F.greatest(*[unit(c) for c in RGB])
        value = {c: K.shared_peak_gamma(unit(c), peak, g, F.col("tint"), s) for c in RGB}
    else:
        curve = K.gamma_blend if kind == "gamma" else K.guarded_gamma_blend
        value = {c: curve(unit(c), g, s) for c in RGB}
    still = s == 0
    return p.select("photo", "y", "x", *RGB, *[F.when(still, F.col(c)).otherwise(K.round_code(v)).alias("out_" + c) for c, v in value.items()])


def dark_controls(pixels: DataFrame, ids: DataFrame | None = None, factor: float = 0.125) -> DataFrame:
    """Darker linear-light copies of the photos in ``ids`` (all without it), linked to their parents."""
    chosen = pixels if ids is None else pixels.join(ids.select("photo"), "photo", "left_semi")
    dim = lambda c: K.round_code(K.to_display(K.to_linear(unit(c)) * factor)).alias(c)
    return chosen.select(F.concat(F.col("photo").cast("string"), F.lit("_dark_control")).alias("photo"), F.col("photo").alias("parent"), "y", "x", *[dim(c) for c in RGB])


def apply_lut3d(pixels: DataFrame, bases: DataFrame, weights: DataFrame, nodes: int = 33, count: int = 3) -> DataFrame:
    """Trilinear lookup in the weighted sum of basis tables, without a shuffle of the pixels.

    ``bases``: nodes^3 rows (ri, gi, bi, v) with v = array of ``count`` channel triples; its size is fixed by
    ``nodes``, so each of the eight corner lookups is a broadcast. ``weights``: (photo, weights array).
    """
    if nodes > 65:
        raise ValueError("lookup table above its broadcast bound")
    table = F.broadcast(bases.select(((F.col("ri") * nodes + F.col("gi")) * nodes + F.col("bi")).alias("_node"), "v"))
    p = pixels.join(weights.select("photo", "weights"), "photo")
    for c in RGB:
        at = F.least(unit(c) / 1.0001 * (nodes - 1), F.lit(float(nodes - 1)))
        low = F.least(F.floor(at), F.lit(nodes - 1)).cast("int")
        p = p.withColumn(f"_i{c}", low).withColumn(f"_f{c}", at - F.col(f"_i{c}"))
    mixed = [F.lit(0.0)] * 3
    for corner in range(8):
        up = [(corner >> k) & 1 for k in range(3)]
        node = F.lit(0)
        share = F.lit(1.0)
        for k, c in enumerate(RGB):
            node = node * nodes + F.least(F.col(f"_i{c}") + up[k], F.lit(nodes - 1))
            share = share * (F.col(f"_f{c}") if up[k] else F.lit(1.0) - F.col(f"_f{c}"))
        p = p.withColumn("_node", node).join(table.withColumnRenamed("v", f"_v{corner}"), "_node").drop("_node").withColumn(f"_w{corner}", share)
        value = lambda i, v=f"_v{corner}": sum((F.col("weights")[k] * F.col(v)[k][i] for k in range(1, count)), F.col("weights")[0] * F.col(v)[0][i])
        mixed = [m + value(i) * F.col(f"_w{corner}") for i, m in enumerate(mixed)]
    return p.select("photo", "y", "x", *RGB, *[F.floor(K.clamp(m * 255 + 0.5, 0.0, 255.0)).cast("int").alias("out_" + c) for m, c in zip(mixed, RGB)])


# ---------------------------------------------------------------- guards and evidence


def _black(prefix: str) -> Column:
    return F.greatest(*[F.col(prefix + c) for c in RGB]) == 0


def _endpoints(src: str, out: str) -> list[Column]:
    """Counts of newly black and newly full positions."""
    return [F.count_if(_black(out) & ~_black(src)), F.count_if(new_full(src, out))]


def _darkening(src: str, out: str) -> Column:
    """Largest luma loss, in codes, where the source is in shadow."""
    y0, y1 = (K.luma(*[F.col(p + c).cast("double") for c in RGB]) for p in (src, out))
    return F.coalesce(F.least(F.min(F.when(unit_luma(src) <= 0.35, y1 - y0)), F.lit(0.0)), F.lit(0.0))


def endpoint_guard(rows: DataFrame, key: str = "photo") -> DataFrame:
    """Newly black and newly full positions of out_* against r, g, b, and the largest shadow darkening."""
    black, full = _endpoints("", "out_")
    g = rows.groupBy(key).agg(black.alias("new_black"), full.alias("new_full"), _darkening("", "out_").alias("shadow_delta"))
    return g.withColumn("accepted", (F.col("new_black") == 0) & (F.col("new_full") == 0) & (F.col("shadow_delta") >= -0.501))


def wb_guard(rows: DataFrame, key: str = "photo") -> DataFrame:
    """Endpoint counts and the largest luma and channel change of a white-balance map."""
    change = [F.abs((F.col("out_" + c) - F.col(c)).cast("double")) for c in RGB]
    moved = F.abs(K.luma(*[(F.col("out_" + c) - F.col(c)).cast("double") for c in RGB]))
    g = rows.groupBy(key).agg(
        F.count_if(_black("out_") & ~_black("")).alias("new_black"), F.count_if(new_full("", "out_")).alias("new_full"),
        F.max(moved).alias("luma_change"), F.max(F.greatest(*change)).alias("channel_change"))
    return g.withColumn("accepted", (F.col("new_black") == 0) & (F.col("new_full") == 0) & (F.col("luma_change") <= 0.501) & (F.col("channel_change") <= 10.501))


def clip_diagnostics(rows: DataFrame, key: str = "photo") -> DataFrame:
    """Full-channel shares before, after and new, source ceilings and the changed share (r,g,b against out_*)."""
    before = F.greatest(*[F.col(c) for c in RGB]) == 255
    after = F.greatest(*[F.col("out_" + c) for c in RGB]) == 255
    white = F.least(*[F.col(c) for c in RGB]) == 255
    moved = (F.col("r") != F.col("out_r")) | (F.col("g") != F.col("out_g")) | (F.col("b") != F.col("out_b"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(key).agg(share(before).alias("before_full"), share(after).alias("after_full"), share(after & ~before).alias("new_full"),
                                 share(white).alias("source_white"), share(moved).alias("changed"))


def recipe_gate(recipes: DataFrame, diagnostics: DataFrame, limit: float = 0.001) -> DataFrame:
    """Reject a proposed recipe that newly clips more than ``limit`` of the pixels."""
    j = recipes.join(diagnostics.select("photo", "new_full"), "photo")
    worse = (F.col("recipe") != "unchanged") & (F.col("new_full") > limit)
    return j.withColumn("reason", F.when(worse, "candidate rejected by clipping guard").otherwise("")).withColumn("selected", F.when(worse, "unchanged").otherwise(F.col("recipe")))


def neutral_evidence(rows: DataFrame, min_pixels: int = 128, min_share: float = 0.02, min_quadrant: int = 64, key: str = "photo") -> DataFrame:
    """Evidence that out_* moves near-neutral pixels of r,g,b consistently towards neutral; needs h and w columns.

    Everything is a conditional aggregate of one pass; ``reason`` is empty when the evidence holds.
    """
    y0, y1 = unit_luma(), unit_luma("out_")
    spread = F.greatest(*[unit(c) for c in RGB]) - F.least(*[unit(c) for c in RGB])
    mask = (y0 >= 0.15) & (y0 <= 0.9) & (spread <= 0.22)
    quad = F.when(F.col("y") < F.floor(F.col("h") / 2), 0).otherwise(2) + F.when(F.col("x") < F.floor(F.col("w") / 2), 0).otherwise(1)
    p = rows.withColumn("_in", mask).withColumn("_quad", quad)
    p = p.withColumns({f"_b{c}": unit(c) - y0 for c in RGB}).withColumns({f"_a{c}": unit("out_" + c) - y1 for c in RGB})
    where_in = lambda v: F.when(F.col("_in"), v)
    aggs = [F.count_if("_in").alias("n"), F.count(F.lit(1)).alias("total"),
            F.avg(where_in(sum(F.abs(f"_b{c}") for c in RGB) / 3)).alias("before"), F.avg(where_in(sum(F.abs(f"_a{c}") for c in RGB) / 3)).alias("after")]
    aggs += [F.avg(where_in(F.col(f"_a{c}") - F.col(f"_b{c}"))).alias(f"d{c}") for c in RGB]
    for q in range(4):
        here = lambda v, q=q: F.when(F.col("_in") & (F.col("_quad") == q), v)
        aggs.append(F.count(here(F.lit(1))).alias(f"n{q}"))
        aggs += [F.avg(here(F.col(f"_a{c}") - F.col(f"_b{c}"))).alias(f"d{c}{q}") for c in RGB]
    g = p.groupBy(key).agg(*aggs).withColumn("length", F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in RGB)))
    cosines = [
        F.when(F.col(f"n{q}") >= min_quadrant, sum(F.col(f"d{c}{q}") * F.col(f"d{c}") for c in RGB)
               / F.greatest(F.sqrt(sum(F.col(f"d{c}{q}") * F.col(f"d{c}{q}") for c in RGB)) * F.col("length"), F.lit(1e-12))) for q in range(4)
    ]
    g = g.withColumn("_cos", F.array_compact(F.array(*cosines)))
    reason = (
        F.when((F.col("n") < min_pixels) | (F.col("n") / F.col("total") < min_share), "insufficient_neutral_candidates")
        .when((F.col("before") < 0.01) | (F.col("after") > F.col("before") * 0.9) | (F.col("length") < 0.003), "no_supported_neutral_improvement")
        .when((F.size("_cos") < 2) | (F.array_min("_cos") < 0.5), "spatial_neutral_disagreement").otherwise("")
    )
    return g.select(key, "n", "total", "before", "after", "length", F.size("_cos").alias("quadrants"), reason.alias("reason"))


def warm_evidence(pixels: DataFrame, scene: DataFrame, min_pixels: int = 128, min_share: float = 0.02, key: str = "photo") -> DataFrame:
    """Warmth of near-neutral pixels and whether a sunset or indoor scene protects it (scene: near_sunset, both_indoor)."""
    y = unit_luma()
    spread = F.greatest(*[unit(c) for c in RGB]) - F.least(*[unit(c) for c in RGB])
    mask = (y >= 0.15) & (y <= 0.9) & (spread <= 0.22)
    g = pixels.groupBy(key).agg(F.count_if(mask).alias("n"), F.count(F.lit(1)).alias("total"), F.avg(F.when(mask, unit("r") - unit("b"))).alias("_w"))
    enough = (F.col("n") >= min_pixels) & (F.col("n") / F.col("total") >= min_share)
    j = g.withColumn("warmth", F.when(enough, F.col("_w"))).join(scene.select(key, "near_sunset", "both_indoor"), key)
    held = F.coalesce(F.col("warmth") > 0.02, F.lit(False)) & (F.col("near_sunset") | F.col("both_indoor"))
    return j.select(key, "warmth", "near_sunset", "both_indoor", held.alias("protected"))


def fit_color_poly(both: DataFrame, key: str = "photo") -> DataFrame:
    """Least-squares 11-term color map per photo from r,g,b to adj_*: (photo, coef, rank, condition).

    The normal equations are sums combined map-side; only 99 numbers per photo reach the small solve.
    """
    terms = K.color_terms(*[unit(c) for c in RGB])
    pairs = [(i, j) for i in range(11) for j in range(i, 11)]
    named = both.select(key, *[t.alias(f"t{i}") for i, t in enumerate(terms)], *[unit("adj_" + c).alias(f"q{c}") for c in RGB])
    gram = named.groupBy(key).agg(
        F.array(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in pairs]).alias("g"),
        F.array(*[F.sum(F.col(f"t{i}") * F.col(f"q{c}")) for i in range(11) for c in RGB]).alias("m"))

    def solve(batches):
        import numpy as np
        import pandas as pd

        rows, cols = np.array(pairs).T
        for batch in batches:
            out = []
            for photo, g, m in zip(batch[key], batch["g"], batch["m"]):
                a = np.zeros((11, 11))
                a[rows, cols] = g
                a[cols, rows] = g
                values, vectors = np.linalg.eigh(a)
                singular = np.sqrt(np.clip(values, 0, None))
                keep = singular > 1e-6 * singular[-1]
                inverse = vectors[:, keep] @ np.diag(1 / values[keep]) @ vectors[:, keep].T
                coef = inverse @ np.asarray(m).reshape(11, 3)
                out.append((photo, coef.ravel().tolist(), int(keep.sum()), float(singular[-1] / max(singular[0], 1e-12))))
            yield pd.DataFrame(out, columns=[key, "coef", "rank", "condition"])

    return gram.mapInPandas(solve, f"{key} {both.schema[key].dataType.simpleString()}, coef array<double>, rank int, condition double")


def wb_decision(scene: DataFrame, fits: DataFrame, attempts: DataFrame, key: str = "photo") -> DataFrame:
    """Applied mode or skip reason per photo.

    ``scene``: (photo, available, document, luma_median, night_both, protected); ``fits``: (photo, rank, condition);
    ``attempts``: (photo, mode, reason, accepted) for the candidate maps; the full map is tried before tint only, and
    a protected warm scene allows tint only.
    """
    order = F.when(F.col("mode") == "full_chroma", 0).otherwise(1)
    tried = attempts.join(scene.select(key, "protected"), key).where(~F.col("protected") | (F.col("mode") == "tint_only")).withColumn("_o", order)
    picked = tried.groupBy(key).agg(
        F.min(F.when(F.col("reason") == "", F.struct("_o", "mode", "accepted"))).alias("_ok"), F.max(F.struct("_o", "reason")).alias("_last"))
    j = scene.join(fits.select(key, "rank", "condition"), key, "left").join(picked, key, "left")
    unavailable = "white_balance_unavailable_or_rejected"
    reason = (
        F.when(~F.col("available"), "recognition_unavailable").when(F.col("document"), "document_preserved")
        .when(F.col("luma_median") < 0.06, "very_dark_source").when((F.col("luma_median") < 0.25) & F.col("night_both"), "two_view_dark_night_retained")
        .when(F.col("rank").isNull(), unavailable).when((F.col("rank") < 11) | (F.col("condition") > 1e6), "unsupported_color_mapping")
        .when(F.col("_ok").isNotNull() & F.col("_ok.accepted"), "consistent_bounded_neutral_correction")
        .when(F.col("_ok").isNotNull(), unavailable).otherwise(F.coalesce(F.col("_last.reason"), F.lit(unavailable)))
    )
    out = j.withColumn("reason", reason)
    return out.select(key, "reason", (F.col("reason") == "consistent_bounded_neutral_correction").alias("applied"),
                      F.when(F.col("reason") == "consistent_bounded_neutral_correction", F.col("_ok.mode")).otherwise("").alias("mode"))


def monotone_steps(ramp: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Number of decreasing steps of an ordered ramp (one ramp is at most one row per code or grid point)."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return ramp.withColumn("_s", step).groupBy(*keys).agg(F.count_if(F.col("_s") < 0).alias("decreasing"), F.count(F.lit(1)).alias("points"))


def crop_consistency(pixels: DataFrame, job, boxes: list[tuple[int, int, int, int]]) -> DataFrame:
    """Rows that differ between a pointwise job on crops and the crops of the job (empty when consistent)."""
    inside = F.lit(False)
    for y0, y1, x0, x1 in boxes:
        inside = inside | ((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    sound_unions(pixels.sparkSession)
    first, last = job(pixels.where(inside)), job(pixels).where(inside)
    return first.exceptAll(last).unionByName(last.exceptAll(first))


def as_source(based: DataFrame, *carried: str) -> DataFrame:
    """Protected pixels as the input of the next map: the original becomes src_*, out_* becomes r, g, b."""
    return based.select("photo", "y", "x", *carried, *[F.col(c).alias("src_" + c) for c in RGB], *[F.col("out_" + c).alias(c) for c in RGB])


def natural_report(final: DataFrame, strengths: DataFrame) -> DataFrame:
    """Guard of src_*, r, g, b and out_* in one pass: (photo, new_black, new_full, strength, applied)."""
    base_black, base_full = _endpoints("src_", "")
    black, full = _endpoints("src_", "out_")
    guard = final.groupBy("photo").agg(black.alias("new_black"), full.alias("new_full"), (base_black + base_full).alias("_base"), _darkening("src_", "").alias("_dark"))
    return guard.join(strengths, "photo").select(
        "photo", "new_black", "new_full", "strength",
        ((F.col("new_black") + F.col("new_full") + F.col("_base") == 0) & (F.col("_dark") >= -0.501)).alias("applied"))


def kept_pixels(final: DataFrame) -> DataFrame:
    """Final pixels where ``applied`` holds, else the original ones."""
    return final.select("photo", "y", "x", *[F.when(F.col("applied"), F.col("out_" + c)).otherwise(F.col("src_" + c)).alias(c) for c in RGB])


def natural_adjust(pixels: DataFrame, proposal: DataFrame, limits: DataFrame, edge: int = 256) -> tuple[DataFrame, DataFrame]:
    """Protected color, shadow lift and the final guard; a photo that fails keeps its original pixels.

    ``limits``: (photo, color_strength, tone_lift, shadow_strength). Returns (pixels, report per photo). This is the form
    for pixel tables, whose rows are shuffled; ``tiles.natural_adjust_tiles`` doesn't.
    """
    from photospark.operators import features as E

    both = E.join_pixels(pixels, proposal)
    found = E.adjust_settings(E.sample_grid(both, edge))
    based = protect_color(both, found, limits)
    suggested = found.join(limits.select("photo", "shadow_strength"), "photo").select("photo", F.least("suggested_strength", "shadow_strength").alias("strength"))
    # source, base and final pixels stay on one row, so the pixel tables are joined only once
    final = lift_shadows(as_source(based), suggested)
    report = natural_report(final, suggested)
    return kept_pixels(final.join(report.select("photo", "applied"), "photo")), report
