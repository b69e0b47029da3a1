"""Vector and bit helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two numeric arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, zero when a side has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def all_finite(a: Column) -> Column:
    """True when no element is null, NaN or infinite."""
    return F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two BIGINT codes."""
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: list[Column]) -> Column:
    """Booleans to one BIGINT, first bit lowest."""
    total = F.lit(0).cast("bigint")
    for i, bit in enumerate(bits):
        total = total.bitwiseOR(F.when(bit, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return total


def center_of_bins(histogram: Column, bins: int = 32, top: float = 100.0) -> Column:
    """Histogram mean estimated from bin centers, in index order."""
    weighted = F.transform(
        F.slice(histogram, 1, bins),
        lambda h, i: h.cast("double") * (i.cast("double") + F.lit(0.5)) * F.lit(top / bins),
    )
    return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)
