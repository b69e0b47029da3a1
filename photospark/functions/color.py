"""Pointwise color and tone formulas on Column expressions (all inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights.
LUMA = (0.2126, 0.7152, 0.0722)
# Linear RGB to wide-gamut RGB, linear RGB to XYZ (D50), and the D50 white point.
RGB_TO_WIDE = (
    (0.529317, 0.330092, 0.140588),
    (0.098368, 0.873465, 0.028169),
    (0.016879, 0.117663, 0.865457),
)
RGB_TO_XYZ = (
    (0.436083, 0.385083, 0.143055),
    (0.222507, 0.716888, 0.060608),
    (0.013930, 0.097097, 0.714022),
)
D50_XY = (0.3457, 0.3585)


def clamp(v: Column, lo: float | Column = 0.0, hi: float | Column = 1.0) -> Column:
    """Limit a value to [lo, hi]."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(v, lo), hi)


def top(*values: Column) -> Column:
    """Largest of several columns."""
    return F.greatest(*values)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Weighted brightness."""
    return r * F.lit(LUMA[0]) + g * F.lit(LUMA[1]) + b * F.lit(LUMA[2])


def to_linear(v: Column) -> Column:
    """Display-coded value in [0,1] to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_display(v: Column) -> Column:
    """Linear light in [0,1] to a display-coded value."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def round_code(v: Column) -> Column:
    """Half-even 8-bit code of a value in [0,1]."""
    return F.rint(clamp(v) * 255).cast("int")


def floor_code(v: Column) -> Column:
    """Half-up 8-bit code of a value in [0,1]."""
    return F.floor(clamp(v) * 255 + 0.5).cast("int")


def smoothstep(lo: float, hi: float, v: Column) -> Column:
    """Cubic ramp from 0 at ``lo`` to 1 at ``hi``."""
    t = clamp((v - lo) / (hi - lo))
    return t * t * (F.lit(3.0) - t * 2)


def mired(kelvin: Column) -> Column:
    """Reciprocal megakelvin."""
    return F.lit(1e6) / kelvin


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio in dB with a floor of 1e-15 on the error."""
    return F.log10(F.greatest(mse, F.lit(1e-15))) * -10


def shadow_curve(y: Column, strength: Column) -> Column:
    """Brightness lift for shadows; identity above mid tones and in deep black."""
    lift = strength * 1.8 * y * F.pow(F.lit(1.0) - y, F.lit(6.0))
    return y + lift * smoothstep(0.008, 0.045, y) * (F.lit(1.0) - smoothstep(0.25, 0.55, y))


def gamma_blend(v: Column, gamma: Column, strength: Column) -> Column:
    """Gamma curve mixed with the input."""
    return (F.lit(1.0) - strength) * v + strength * F.pow(v, gamma)


def guarded_gamma_blend(v: Column, gamma: Column, strength: Column, max_gain: float = 8.0) -> Column:
    """Gamma curve whose gain never exceeds ``max_gain``, mixed with the input."""
    return (F.lit(1.0) - strength) * v + strength * F.least(F.pow(v, gamma), v * max_gain)


def shared_peak_gamma(v: Column, peak: Column, gamma: Column, tint: Column, strength: Column) -> Column:
    """One gain per pixel from the peak channel plus a bounded chroma term."""
    safe = F.greatest(peak, F.lit(1e-8))
    lifted = v * (F.least(F.pow(safe, gamma), peak * 8) / safe)
    tinted = lifted + tint * lifted * (F.lit(1.0) - lifted)
    return (F.lit(1.0) - strength) * v + strength * tinted


def skin_weight(r: Column, g: Column, b: Column) -> Column:
    """Continuous skin-color proxy from the two chroma axes."""
    cb = (r * -0.168736 - g * 0.331264 + b * 0.5 + 0.5) * 255
    cr = (r * 0.5 - g * 0.418688 - b * 0.081312 + 0.5) * 255
    return (
        clamp((cb - 70) / 15) * clamp((F.lit(135.0) - cb) / 10)
        * clamp((cr - 125) / 15) * clamp((F.lit(185.0) - cr) / 15)
    )


def color_terms(r: Column, g: Column, b: Column) -> list[Column]:
    """The eleven terms of the color polynomial."""
    return [r, g, b, r * g, r * b, g * b, r * r, g * g, b * b, r * g * b, F.lit(1.0)]


def _inverse3(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [
        [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
        [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
        [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
    ]


def wide_to_xyz_matrix() -> list[list[float]]:
    """Linear wide-gamut RGB to XYZ (D50), composed from the two fixed matrices."""
    inverse = _inverse3(RGB_TO_WIDE)
    return [[sum(RGB_TO_XYZ[i][k] * inverse[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def wide_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """Linear wide-gamut RGB to Lab relative to D50."""
    x0, y0 = D50_XY
    white = (x0 / y0, 1.0, (1 - x0 - y0) / y0)

    def bend(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * (841 / 108) + 4 / 29)

    fx, fy, fz = [
        bend((r * row[0] + g * row[1] + b * row[2]) / white[i]) for i, row in enumerate(wide_to_xyz_matrix())
    ]
    return [fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200]


def letterbox(h: Column, w: Column, edge: int = 224) -> list[Column]:
    """Fitted height and width inside a square and the centered top/left offsets."""
    scale = F.lit(float(edge)) / F.greatest(h, w)
    fit_h = F.greatest(F.lit(1.0), F.rint(h * scale)).cast("int")
    fit_w = F.greatest(F.lit(1.0), F.rint(w * scale)).cast("int")
    return [fit_h, fit_w, F.floor((F.lit(edge) - fit_h) / 2).cast("int"), F.floor((F.lit(edge) - fit_w) / 2).cast("int")]
