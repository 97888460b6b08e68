"""Vector columns: array<float> or array<double>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.when(size > 0, size)).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 if either norm is 0."""
    return F.lit(1.0) - cosine(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def normalized(v: Column) -> Column:
    """Unit length; unchanged if the norm is 0."""
    return let(norm(v), lambda size: F.transform(doubles(v), lambda x: F.when(size > 0, x / F.when(size > 0, size)).otherwise(x)))


def resized(v: Column, width: int | Column) -> Column:
    """Truncated or padded with zeros to ``width``."""
    wide = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.slice(doubles(v), F.lit(1), wide), F.array_repeat(F.lit(0.0), F.greatest(wide - F.size(v), F.lit(0))))


def quantize_int16(v: Column) -> Column:
    """Clamped to [-1, 1], times 32767, rounded half away from zero."""
    return F.transform(doubles(v), lambda x: F.round(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int"))


def quantize_4bit(v: Column) -> Column:
    """struct(scale, codes 0..15) with the largest magnitude as scale; an all-zero vector has scale 0 and codes 8."""

    def coded(scale: Column) -> Column:
        safe = F.when(scale > 0, scale)
        codes = F.transform(doubles(v), lambda x: F.coalesce(F.greatest(F.least(F.round((x / safe + 1) * 7.5), F.lit(15.0)), F.lit(0.0)), F.lit(8.0)).cast("int"))
        return F.struct(F.coalesce(scale, F.lit(0.0)).alias("scale"), codes.alias("codes"))

    return let(F.array_max(F.transform(doubles(v), lambda x: F.abs(x))), coded)


def dequantize_4bit(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (c / F.lit(7.5) - 1) * q["scale"])


def hint_score(q: Column, direction: Column) -> Column:
    """Dot product of the dequantised codes with a direction."""
    return dot(dequantize_4bit(q), direction)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once for each row however often ``body`` uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sorted_quantiles(v: Column, bins: int) -> Column:
    """``bins`` values at evenly spaced rounded places of the sorted vector, centred and of unit length."""

    def picked(ordered: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.get(ordered, F.round(i * (F.size(ordered) - 1) / F.lit(max(bins - 1, 1))).cast("int")))

    def centred(picks: Column) -> Column:
        return let(total(picks) / bins, lambda mean: F.transform(picks, lambda x: x - mean))

    return let(let(let(F.sort_array(doubles(v)), picked), centred), normalized)
