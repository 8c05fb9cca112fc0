"""Plain distributions and whole-number functions as column expressions: no Python worker, no shuffle. A null gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeframe.functions.expressions import log_choose


def _told(x: Column, value: Column) -> Column:
    return F.when(x.isNotNull(), value)


def choose(n: Column, k: Column) -> Column:
    """n over k, rounded to a whole number; 0 unless 0 <= k <= n."""
    return F.when(n.isNotNull() & k.isNotNull(), F.coalesce(F.round(F.exp(log_choose(n, k))), F.lit(0.0)))


def bernoulli_mass(k: Column, p: float) -> Column:
    return _told(k, F.when(k == 1, p).when(k == 0, 1 - p).otherwise(0.0))


def geometric_mass(k: Column, p: float) -> Column:
    """k failures before the first success."""
    return _told(k, F.when(k < 0, 0.0).otherwise(p * F.pow(F.lit(1 - p), F.greatest(k, F.lit(0)))))


def geometric_cdf(k: Column, p: float) -> Column:
    return _told(k, F.when(k < 0, 0.0).otherwise(1 - F.pow(F.lit(1 - p), F.greatest(F.floor(k), F.lit(0)) + 1)))


def shifted_geometric_mass(k: Column, p: float) -> Column:
    """The first success at the k-th trial."""
    return geometric_mass(k - 1, p)


def hypergeometric_mass(k: Column, total: int, marked: int, drawn: int) -> Column:
    """k marked ones among those drawn without return."""
    one = lambda n, j: log_choose(F.lit(n), j)
    return _told(k, F.coalesce(F.exp(one(marked, k) + one(total - marked, drawn - k) - one(total, F.lit(drawn))), F.lit(0.0)))


def logistic_density(x: Column, centre: float, scale: float) -> Column:
    e = F.exp(-F.abs((x - centre) / scale))
    return e / (scale * (1 + e) * (1 + e))


def logistic_cdf(x: Column, centre: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(x - centre) / scale))


def logistic_quantile(p: Column, centre: float, scale: float) -> Column:
    """Null unless 0 < p < 1."""
    return F.when((p > 0) & (p < 1), centre + scale * F.log(p / (1 - p)))


def beta_density(x: Column, a: float, b: float) -> Column:
    """0 outside the unit interval and, for simplicity, at its ends."""
    ln = (a - 1) * F.log(x) + (b - 1) * F.log(1 - x) + (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return _told(x, F.when((x > 0) & (x < 1), F.exp(ln)).otherwise(0.0))


def uniform_density(x: Column, low: float, high: float) -> Column:
    return _told(x, F.when((x >= low) & (x <= high), 1 / (high - low)).otherwise(0.0))


def triangular_density(x: Column, low: float, peak: float, high: float) -> Column:
    width = high - low
    rise = 2 * (x - low) / (width * (peak - low)) if peak > low else F.lit(0.0)
    fall = 2 * (high - x) / (width * (high - peak)) if high > peak else F.lit(0.0)
    return _told(x, F.when((x < low) | (x > high), 0.0).when(x < peak, rise).when(x == peak, 2 / width).otherwise(fall))


def triangular_quantile(p: Column, low: float, peak: float, high: float) -> Column:
    """Null outside the unit interval."""
    width, left = high - low, (peak - low) / (high - low)
    rise, fall = low + F.sqrt(F.greatest(p, F.lit(0.0)) * width * (peak - low)), high - F.sqrt(F.greatest(1 - p, F.lit(0.0)) * width * (high - peak))
    return _told(p, F.when((p >= 0) & (p <= 1), F.when(p < left, rise).otherwise(fall)))


def power_law_mass(k: Column, exponent: float, top: int) -> Column:
    """k from 1 to ``top``, with weights k^-exponent."""
    z = math.fsum(i**-exponent for i in range(1, top + 1))
    return _told(k, F.when((k >= 1) & (k <= top), F.pow(F.greatest(k, F.lit(1)), F.lit(-exponent)) / z).otherwise(0.0))


#: With these bases the strong test errs for no number below 3.3 * 10^24, so for no long.
_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def is_prime(n: Column) -> Column:
    """Whether a long is prime; null for null. Exact: small factors first, then the strong test for each of the fixed bases, its products in 38 decimal digits."""
    whole = n.cast("long")
    wide = lambda c: c.cast("decimal(19,0)")
    bits = F.sequence(F.lit(62), F.lit(0), F.lit(-1))

    def passed(base: int) -> Column:
        # base^(n - 1) from the exponent's highest digit down: a square of 1 whose root is neither 1 nor n - 1 betrays a composite number.
        def step(acc, i):
            square = wide(acc["x"] * acc["x"] % wide(whole))
            fine = acc["fine"] & ~((square == 1) & (acc["x"] != 1) & (acc["x"] != wide(whole - 1)))
            on = F.call_function("shiftright", whole - 1, i).bitwiseAND(F.lit(1).cast("long")) == 1
            return F.struct(F.when(on, wide(square * F.lit(base).cast("decimal(19,0)") % wide(whole))).otherwise(square).alias("x"), fine.alias("fine"))

        start = F.struct(F.lit(1).cast("decimal(19,0)").alias("x"), F.lit(True).alias("fine"))
        return F.aggregate(bits, start, step, lambda acc: acc["fine"] & (acc["x"] == 1))

    small = F.lit(False)
    for p in _BASES:
        small = small | (whole % p == 0)
    test = F.when(whole < 2, False).when(whole.isin(*_BASES), True).when(small, False).when(whole < 41 * 41, True)
    for base in _BASES:
        test = test.when(~passed(base), False)
    return _told(n, test.otherwise(True))


def mode(x: Column) -> Column:
    """An array's most frequent value, the smallest of such; null for none."""
    kinds = F.array_sort(F.array_distinct(F.array_compact(x)))
    counted = F.transform(kinds, lambda v: F.struct(F.size(F.filter(x, lambda w: w == v)).alias("n"), v.alias("v")))
    top = F.array_max(F.transform(counted, lambda c: c["n"]))
    return F.try_element_at(F.filter(counted, lambda c: c["n"] == top), F.lit(1))["v"]
