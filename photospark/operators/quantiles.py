"""Exact quantiles and ranks that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.session import cut_lineage


#: A 64-bit key is resolved in four digits, so a histogram has at most 65,536 bins.
DIGIT, DIGITS = 16, 4
_FRACTION, _LEAST, _HALF = 2.0 ** 52, 2.0 ** -1022, 2.0 ** 537
_INFINITE, _NAN = 0x7FF0 << 48, 0x7FF8 << 48


def order_key(value: Column) -> Column:
    """A BIGINT in the order of the doubles: the bits of the absolute value, negated below zero.

    Every step is exact: scaling by powers of two only, with the exponent corrected by comparisons. NaN comes last,
    both zeros are 0.
    """
    v = value.cast("double")
    size = F.abs(v)
    rough = F.floor(F.log2(size))
    power = F.when(F.pow(F.lit(2.0), rough) > size, rough - 1).when(F.pow(F.lit(2.0), rough + 1) <= size, rough + 1).otherwise(rough)
    normal = (power + 1023) * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), power) - 1) * _FRACTION).cast("long")
    bits = F.when(F.isnan(v), F.lit(_NAN)).when(size == float("inf"), F.lit(_INFINITE)).when(size < _LEAST, (size * _HALF * _HALF).cast("long")).otherwise(normal)
    return F.when(v < 0, -bits).otherwise(bits).cast("long")


def key_value(key: Column) -> Column:
    """The double of an ``order_key``."""
    bits = F.abs(key)
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    size = F.when(bits >= _NAN, float("nan")).when(bits >= _INFINITE, float("inf")).when(bits < 1 << 52, fraction / _HALF / _HALF).otherwise(
        (1 + fraction / _FRACTION) * F.pow(F.lit(2.0), F.shiftright(bits, 52) - 1023))
    return F.when(key < 0, -size).otherwise(size)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Rows (keys.., p, value): linear-interpolated percentiles, equal to a full sort.

    Radix selection: the values become 64-bit keys in their order, written once. Four passes count the digits of those
    that share the digits found so far with a wanted rank; all keys and probabilities go through the same passes. Counting combines
    map-side, a window sees the bins of one histogram (at most 65,536), and no row is ever sorted. Null values are
    left out, a null key is a key, and NaN is larger than all numbers.
    """
    of = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    src = cut_lineage(df.select(of.alias("_g"), order_key(F.col(f"`{value}`")).alias("_k")).where("_k IS NOT NULL"))
    digit = lambda level: F.shiftright("_k", DIGIT * (DIGITS - 1 - level)) if not level else F.shiftright("_k", DIGIT * (DIGITS - 1 - level)).bitwiseAND(F.lit((1 << DIGIT) - 1))
    place = F.struct("_i", "_side", "_rest")
    bins = src.groupBy("_g", digit(0).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("_g")
    bins = bins.withColumn("_n", F.sum("_c").over(whole))
    ranks = []
    for i, p in enumerate(probs):
        first = F.floor(F.lit(float(p)) * (F.col("_n") - 1)).cast("long") + 1
        ranks += [F.struct(F.lit(i).alias("_i"), F.lit(side).alias("_side"), rank.alias("_rest")) for side, rank in ((0, first), (1, F.least(first + 1, F.col("_n"))))]
    found = _digits(bins.withColumns({"_w": F.array(*ranks), "_p": F.lit(0).cast("long")}), ["_g"])
    for level in range(1, DIGITS):
        wanted = found.groupBy("_g", "_p", "_n").agg(F.collect_list(place).alias("_w"))
        inside = src.withColumn("_p", F.shiftright("_k", DIGIT * (DIGITS - level))).join(wanted, ["_g", "_p"])
        bins = inside.groupBy("_g", "_p", "_n", "_w", digit(level).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        found = _digits(bins, ["_g", "_p"])
    ends = found.groupBy("_g", "_i", "_n").agg(*[F.max(F.when(F.col("_side") == side, F.col("_p"))).alias(name) for side, name in ((0, "_a"), (1, "_b"))])
    p = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    low, high, at = key_value(F.col("_a")), key_value(F.col("_b")), p * (F.col("_n") - 1)
    exact = (F.col("_a") == F.col("_b")) | (at == F.floor(at))
    return ends.select(*[F.col("_g")[k].alias(k) for k in keys], p.alias("p"), F.when(exact, low).otherwise(low + (high - low) * (at - F.floor(at))).alias("value"))


def _digits(bins: DataFrame, by: list[str]) -> DataFrame:
    """The wanted ranks ``_w`` of each histogram with the digit of their bin appended to the prefix ``_p`` and their rank inside it."""
    upto = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.withColumn("_end", F.sum("_c").over(upto)).withColumn("_before", F.col("_end") - F.col("_c"))
    here = F.filter("_w", lambda w: (w["_rest"] > F.col("_before")) & (w["_rest"] <= F.col("_end")))
    rows = placed.select("_g", "_n", "_before", (F.shiftleft("_p", DIGIT) + F.col("_d")).alias("_p"), F.explode(here).alias("_t"))
    return rows.select("_g", "_n", "_p", F.col("_t._i").alias("_i"), F.col("_t._side").alias("_side"), (F.col("_t._rest") - F.col("_before")).alias("_rest"))


def percentile_struct(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row with a named column per percentile of the whole column."""
    q = exact_percentiles(df, [], value, list(probs.values()))
    return q.agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("value"))).alias(n) for n, p in probs.items()])


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based rank over the whole table: range-partitioned sort plus one offset per partition.

    The sorted rows are written once to the checkpoint folder, so positions cannot change when an
    executor is lost between the two passes.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part).join(offsets, "_part")
        .withColumn(name, F.col("_before") + within + 1).drop("_at", "_part", "_before")
    )
