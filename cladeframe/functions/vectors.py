"""Functions of arrays of doubles as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def total(x: Column) -> Column:
    return F.aggregate(x, _zero(), lambda a, v: a + v)


def mean(x: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(x), F.size(x))


def variance(x: Column) -> Column:
    """Sample variance (n - 1); null for fewer than two values."""
    m = mean(x)
    return F.when(F.size(x) > 1, F.try_divide(F.aggregate(x, _zero(), lambda a, v: a + (v - m) * (v - m)), F.size(x) - 1))


def deviation(x: Column) -> Column:
    return F.sqrt(variance(x))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm1(x: Column) -> Column:
    return F.aggregate(x, _zero(), lambda a, v: a + F.abs(v))


def norm2(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def norm_inf(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def cosine(x: Column, y: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(x, y), norm2(x) * norm2(y))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(squared_distance(x, y))


def distance_with_missing(x: Column, y: Column) -> Column:
    """Euclidean distance over the places where both are present, scaled up to the full length; null if there is none."""
    pairs = F.filter(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), lambda d: d.isNotNull() & ~F.isnan(d))
    return F.when(F.size(pairs) > 0, F.sqrt(F.size(x) * total(pairs) / F.size(pairs)))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def log_sum_of_logs(a: Column, b: Column) -> Column:
    """ln(e^a + e^b); minus infinity is neutral."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def entropy(p: Column) -> Column:
    """Natural-log entropy; terms with p <= 0 are left out."""
    return -F.aggregate(p, _zero(), lambda a, v: a + F.when(v > 0, v * F.log(v)).otherwise(0.0))


def kl_divergence(p: Column, q: Column) -> Column:
    """Sum of p ln(p / q) where both are positive; infinite if they are nowhere both positive."""
    both = F.filter(F.zip_with(p, q, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z: (z["a"] > 0) & (z["b"] > 0))
    return F.when(F.size(both) == 0, F.lit(float("inf"))).otherwise(total(F.transform(both, lambda z: z["a"] * F.log(z["a"] / z["b"]))))


def js_divergence(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return (kl_divergence(p, m) + kl_divergence(q, m)) / 2


def which_min(x: Column) -> Column:
    """Place (from 0) of the first minimum."""
    return F.array_position(x, F.array_min(x)) - 1


def which_max(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)) - 1


def unit(x: Column) -> Column:
    """Null components for a zero vector."""
    n = norm2(x)
    return F.transform(x, lambda v: F.try_divide(v, n))


def axpy(a: Column, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda u, v: a * u + v)


def omit(x: Column, value: Column) -> Column:
    return F.filter(x, lambda v: v != value)


def omit_nan(x: Column) -> Column:
    return F.filter(x, lambda v: ~F.isnan(v))


def kth_smallest(x: Column, k: int) -> Column:
    """The k-th smallest value, from 0."""
    return F.element_at(F.sort_array(x), k + 1)


def median(x: Column) -> Column:
    """Element n / 2 of the sorted values; no interpolation."""
    return F.element_at(F.sort_array(x), (F.floor(F.size(x) / 2) + 1).cast("int"))


def quartiles(x: Column) -> Column:
    s, n = F.sort_array(x), F.size(x)
    at = lambda k: F.element_at(s, (F.floor(n * k / 4) + 1).cast("int"))
    return F.struct(at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"))


def inside_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting: whether a point lies within a polygon of few corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            crossings = crossings + F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def round_half_up(x: Column, digits: int) -> Column:
    """Half towards plus infinity, for negative numbers too."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def sigmoid(x: Column) -> Column:
    return F.when(x < -40, 2.353853e-17).when(x > 40, 1.0 - 2.353853e-17).otherwise(1 / (1 + F.exp(-x)))


def log1pe(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.when(x > 15, x).otherwise(F.log1p(F.exp(x)))
