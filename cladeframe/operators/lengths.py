"""Fits of distributions over 1, 2, 3, ... (lengths, ranks, counts) and exact tests of two-by-two tables.

Rows are reduced to a few sums a group by grouped aggregation; what remains is one equation a group, solved over Arrow batches of groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions import special
from cladeframe.operators.scans import scanned

_REALS = lambda *names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
#: Values of a support worked on at a time.
PART = 1 << 20
#: Exponents are sought between minus this and this.
STEEPEST = 64.0


def _parts(low: int, high: int):
    """The whole numbers from low to high, in arrays of bounded length."""
    for a in range(low, high + 1, PART):
        yield np.arange(a, min(high, a + PART - 1) + 1, dtype=float)


def _tilted(n: int, slope: float, log_ratio) -> tuple[float, float]:
    """ln of the sum over k = 1 .. n of exp(slope log_ratio(k)), and the mean of log_ratio under those weights."""
    top, total, first = -np.inf, 0.0, 0.0
    for k in _parts(1, n):
        r = log_ratio(k)
        best = max(top, float((slope * r).max()))
        w = np.exp(slope * r - best)
        shrink = np.exp(top - best) if top > -np.inf else 0.0
        total, first, top = total * shrink + w.sum(), first * shrink + (w * r).sum(), best
    return top + float(np.log(total)), first / total


def _slope(n: int, mean: float, log_ratio) -> float:
    """The slope at which the mean of log_ratio is ``mean``; the mean rises with the slope, so halving finds it."""
    low, high = -STEEPEST, STEEPEST
    while high - low > 1e-12:
        mid = (low + high) / 2
        low, high = (mid, high) if _tilted(n, mid, log_ratio)[1] < mean else (low, mid)
    return (low + high) / 2


@F.pandas_udf(_REALS("s", "log_z"))
def _zipf(n: pd.Series, mean: pd.Series) -> pd.DataFrame:
    """s of k^-s on 1 .. n whose mean ln k is ``mean``."""
    return _solved(n, mean, lambda n, m: 0 < m < np.log(n), lambda n: lambda k: -np.log(k), -1)


@F.pandas_udf(_REALS("s", "log_z"))
def _lavalette(n: pd.Series, mean: pd.Series) -> pd.DataFrame:
    """s of ((n + 1 - k) / k)^s on 1 .. n whose mean ln((n + 1 - k) / k) is ``mean``."""
    return _solved(n, mean, lambda n, m: abs(m) < np.log(n), lambda n: lambda k: np.log((n + 1 - k) / k), 1)


def _solved(n: pd.Series, mean: pd.Series, inside, log_ratio, sign: int) -> pd.DataFrame:
    out = []
    for size, m in zip(n, mean):
        if pd.isna(size) or pd.isna(m) or not inside(int(size), m):
            out.append((None, None))
            continue
        f = log_ratio(int(size))
        s = _slope(int(size), sign * m, f)
        out.append((s, _tilted(int(size), s, f)[0]) if abs(s) < STEEPEST - 1e-9 else (None, None))
    return pd.DataFrame(out, columns=["s", "log_z"], dtype=float)


@F.pandas_udf(T.DoubleType())
def _truncated_rate(mean: pd.Series) -> pd.Series:
    """The rate l with l / (1 - exp(-l)) = mean, by halving; 0 for a mean of 1."""
    m = mean.to_numpy(float)
    low, high = np.zeros_like(m), np.maximum(m, 1e-300)
    for _ in range(200):
        mid = (low + high) / 2
        less = mid / np.maximum(-np.expm1(-mid), 1e-300) < m
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return pd.Series(np.where(np.isnan(m), np.nan, np.where(m <= 1, 0.0, (low + high) / 2)))


def length_fits(df: DataFrame, value: str, on: list[str]) -> DataFrame:
    """Maximum-likelihood fits by group to whole numbers of 1 and more (other values and nulls are left out): n, top (the largest), and rate
    and log-likelihood of a zero-truncated Poisson, exponent and log-likelihood of a Zipf and of a Lavalette law on 1 .. top.

    If all values are 1 the rate is 0 with log-likelihood 0. An exponent is null where none is best (all values equal the largest) and where it would be steeper
    than STEEPEST. The time for a group grows with its largest value, the memory doesn't."""
    x = df.where(F.col(value) >= 1).groupBy(*on, F.floor(F.col(value)).cast("long").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    tops = x.groupBy(*on).agg(F.max("__x").alias("top"))
    met = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in on]
    tops = tops.select(*(F.col(c).alias(f"__g_{c}") for c in on), "top")
    x = x.join(tops, met) if on else x.crossJoin(F.broadcast(tops))  # one row
    x = x.withColumn("__lf", special.lgamma_col(F.col("__x").cast("double") + 1))
    n, v, top = F.col("__n"), F.col("__x"), F.col("top")
    total = lambda e: F.sum(n * e)
    s = x.groupBy(*on).agg(F.sum(n).alias("n"), F.max(top).alias("top"), total(v).cast("double").alias("sx"), total(F.log(v)).alias("sl"), total(F.log((top + 1 - v) / v)).alias("sr"), total(F.col("__lf")).alias("sf"))
    s = s.withColumns({"rate": _truncated_rate(F.col("sx") / F.col("n")), "z": _zipf("top", F.col("sl") / F.col("n")), "l": _lavalette("top", F.col("sr") / F.col("n"))})
    count, rate = F.col("n"), F.col("rate")
    poisson = F.when(rate > 0, F.col("sx") * F.log(rate) - count * rate - F.col("sf") - count * F.log(-F.expm1(-rate))).otherwise(0.0)
    return s.select(
        *on, "n", "top", "rate", poisson.alias("rate_ll"), F.col("z.s").alias("zipf"), (-F.col("z.s") * F.col("sl") - count * F.col("z.log_z")).alias("zipf_ll"),
        F.col("l.s").alias("lavalette"), (F.col("l.s") * F.col("sr") - count * F.col("l.log_z")).alias("lavalette_ll"),
    )


@F.pandas_udf(_REALS("p", "less", "greater", "both"))
def _hypergeometric(k: pd.Series, row: pd.Series, col: pd.Series, n: pd.Series) -> pd.DataFrame:
    g = special.log_gamma
    choose = lambda a, b: g(a + 1) - g(b + 1) - g(a - b + 1)
    out = []
    for x, r, c, t in zip(*(s.astype(int) for s in (k, row, col, n))):
        log_p = lambda v: choose(float(r), v) + choose(float(t - r), c - v) - choose(float(t), float(c))  # noqa: B023, E731
        p = float(np.exp(log_p(np.array([float(x)]))[0]))
        less = greater = both = 0.0
        for v in _parts(max(0, r + c - t), min(r, c)):
            q = np.exp(log_p(v))
            less, greater, both = less + q[v <= x].sum(), greater + q[v >= x].sum(), both + q[q <= p * (1 + 1e-8)].sum()
        out.append((p, min(less, 1.0), min(greater, 1.0), min(both, 1.0)))
    return pd.DataFrame(out, columns=["p", "less", "greater", "both"], dtype=float)


def fisher_exact(df: DataFrame, a: Column, b: Column, on: list[str]) -> DataFrame:
    """Fisher's exact test of two conditions by group: the table n11 (both), n12 (the first alone), n21, n22, its chance p with the margins given, that of as few
    or fewer in n11 (less), as many or more (greater), and of any table that isn't likelier (both). Rows where either condition is null are left out.
    The time for a group grows with its smaller margin, the memory doesn't."""
    x = df.select(*on, a.alias("__a"), b.alias("__b")).dropna(subset=["__a", "__b"])
    hit = lambda c, d: F.count(F.when(c & d, 1))
    s = x.groupBy(*on).agg(hit(F.col("__a"), F.col("__b")).alias("n11"), hit(F.col("__a"), ~F.col("__b")).alias("n12"), hit(~F.col("__a"), F.col("__b")).alias("n21"), hit(~F.col("__a"), ~F.col("__b")).alias("n22"))
    h = _hypergeometric("n11", F.col("n11") + F.col("n12"), F.col("n11") + F.col("n21"), F.col("n11") + F.col("n12") + F.col("n21") + F.col("n22"))
    return s.withColumn("__h", h).select(*on, "n11", "n12", "n21", "n22", "__h.p", "__h.less", "__h.greater", "__h.both")


def latin_hypercube(df: DataFrame, key: str, dimensions: int, seed: int) -> DataFrame:
    """key and u1, u2, ...: a Latin hypercube sample with a point for each row of ``df``. Each dimension has as many equal strata as there are rows; keys in the order
    of a hash with the seed take one each, and a place within it from another. Places come from range-sorted numbers, so no task sorts all. Rows
    alike in ``key``, or null in it, are one point."""
    keys = df.select(key).dropna().distinct()
    total = keys.agg(F.count(F.lit(1)).alias("__t"))
    out = keys
    for d in range(1, dimensions + 1):
        draw = lambda part: F.xxhash64(F.lit(seed), F.lit(d), F.lit(part), F.col(key).cast("string"))  # noqa: B023, E731
        ordered = scanned(keys.withColumn("__o", draw(0)).withColumn("__one", F.lit(1).cast("long")), [], ["__o", key], __i=("sum", "__one", False))
        within = F.pmod(draw(1), F.lit(1 << 52)) / F.lit(float(1 << 52))
        out = out.join(ordered.crossJoin(F.broadcast(total)).select(key, ((F.col("__i") + within) / F.col("__t")).alias(f"u{d}")), key)  # total: one row
    return out
