"""Distributions, radial bases, schedules and complex numbers as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeframe.functions import special


def weibull_density(x: Column, shape: float, scale: float) -> Column:
    """0 below 0."""
    z = x / scale
    return F.when(x < 0, 0.0).otherwise(shape / scale * F.pow(z, F.lit(shape - 1)) * F.exp(-F.pow(z, F.lit(shape))))


def weibull_cdf(x: Column, shape: float, scale: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(-F.expm1(-F.pow(x / scale, F.lit(shape))))


def weibull_quantile(p: Column, shape: float, scale: float) -> Column:
    """Null for a p outside 0 .. 1."""
    return F.when(p.between(0, 1), scale * F.pow(-F.log1p(-p), F.lit(1 / shape)))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k; null unless 0 <= k <= n."""
    one = lambda c: special.lgamma_col(c.cast("double") + 1)
    return F.when((k >= 0) & (k <= n), one(F.greatest(n, k)) - one(F.greatest(k, F.lit(0))) - one(F.greatest(n - k, F.lit(0))))


def negative_binomial_mass(k: Column, r: float, p: float) -> Column:
    """The chance of k failures before the r-th success of chance p; 0 below 0."""
    x = F.greatest(k.cast("double"), F.lit(0.0))
    ln = special.lgamma_col(x + r) - special.lgamma_col(x + 1) - math.lgamma(r) + r * math.log(p) + x * math.log1p(-p)
    return F.when(k < 0, 0.0).otherwise(F.exp(ln))


def negative_binomial_cdf(k: Column, r: float, p: float) -> Column:
    return F.when(k < 0, 0.0).otherwise(special.beta_col(F.lit(float(r)), F.greatest(F.floor(k).cast("double"), F.lit(0.0)) + 1, F.lit(float(p))))


def gaussian_basis(r: Column, width: float) -> Column:
    return F.exp(-0.5 * (r / width) * (r / width))


def multiquadric_basis(r: Column, width: float) -> Column:
    return F.sqrt(r * r + width * width)


def inverse_multiquadric_basis(r: Column, width: float) -> Column:
    return 1 / multiquadric_basis(r, width)


def thin_plate_basis(r: Column, width: float) -> Column:
    """0 up to 0."""
    return F.when(r <= 0, 0.0).otherwise(r * r * F.log(r / width))


def piecewise(t: Column, ends: list[float], values: list[float]) -> Column:
    """The value of the first step whose end t doesn't pass; one value more than ends."""
    out = F.lit(values[-1])
    for end, v in reversed(list(zip(ends, values))):
        out = F.when(t <= end, v).otherwise(out)
    return out


def polynomial_decay(t: Column, first: float, steps: float, last: float, degree: float = 1.0, cycle: bool = False) -> Column:
    """From ``first`` to ``last`` in ``steps``; degree 1 is linear. ``cycle``: beyond that the span is stretched to the next multiple instead of stopping."""
    share = t / (steps * F.greatest(F.lit(1.0), F.ceil(t / steps).cast("double"))) if cycle else F.least(t, F.lit(steps)) / steps
    return (first - last) * F.pow(1 - share, F.lit(degree)) + last


def inverse_decay(t: Column, first: float, steps: float, rate: float = 1.0, staircase: bool = False) -> Column:
    return first / (1 + rate * (F.floor(t / steps) if staircase else t / steps))


def exponential_decay(t: Column, first: float, steps: float, rate: float = math.exp(-1), staircase: bool = False) -> Column:
    return first * F.pow(F.lit(rate), (F.floor(t / steps) if staircase else t / steps).cast("double"))


def cosine_decay(t: Column, first: float, steps: float, last: float) -> Column:
    return last + (first - last) * (1 + F.cos(math.pi * F.least(t, F.lit(steps)) / steps)) / 2


def complex_number(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return complex_number(a["re"] + b["re"], a["im"] + b["im"])


def c_subtract(a: Column, b: Column) -> Column:
    return complex_number(a["re"] - b["re"], a["im"] - b["im"])


def c_multiply(a: Column, b: Column) -> Column:
    return complex_number(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_divide(a: Column, b: Column) -> Column:
    """Parts are null for a divisor of 0."""
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_number(F.try_divide(a["re"] * b["re"] + a["im"] * b["im"], n), F.try_divide(a["im"] * b["re"] - a["re"] * b["im"], n))


def c_modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def c_exp(a: Column) -> Column:
    return complex_number(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def c_sin(a: Column) -> Column:
    return complex_number(F.sin(a["re"]) * F.cosh(a["im"]), F.cos(a["re"]) * F.sinh(a["im"]))


def c_cos(a: Column) -> Column:
    return complex_number(F.cos(a["re"]) * F.cosh(a["im"]), -F.sin(a["re"]) * F.sinh(a["im"]))


def c_tan(a: Column) -> Column:
    return c_divide(c_sin(a), c_cos(a))
