"""Special functions that Spark lacks, as vectorised pandas functions over columns of doubles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lanczos coefficients, g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x), x > 0."""
    z = np.asarray(x, float) - 1
    s = _LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(s)


def digamma(x: np.ndarray) -> np.ndarray:
    """Moved up to x >= 8 by the recurrence, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - 1 / np.where(low, x, 1.0), out)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


# Taylor coefficients in eta of the first terms of Temme's uniform asymptotic expansion.
_TEMME = (
    (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -0.00017875514403292181, 0.39192631785224378e-4, -0.21854485106799922e-5, -0.185406221071516e-5, 0.8296711340953086e-6, -0.17665952736826079e-6, 0.67078535434014986e-8, 0.10261809784240308e-7, -0.43820360184533532e-8, 0.91476995822367902e-9),
    (-1 / 540, -1 / 288, 0.0026455026455026455, -0.00099022633744855967, 0.00020576131687242798, -0.40187757201646091e-6, -0.18098550334489978e-4, 0.76491609160811101e-5, -0.16120900894563446e-5, 0.46471278028074343e-8, 0.1378633446915721e-6),
    (25 / 6048, -0.0026813271604938272, 0.00077160493827160494, 0.20093878600823045e-5, -0.00010736653226365161, 0.52923448829120125e-4, -0.12760635188618728e-4),
    (0.00064943415637860082, 0.00022947209362139918, -0.00046918949439525571),
)
#: Shapes from which the expansion is used; where it isn't good to the last digits, exp(-a eta^2 / 2) is 0.
LARGE_SHAPE = 1e4
#: Relative change at which series and fractions end. More steps than STEPS are an error, never a result.
CHANGE, STEPS = 1e-15, 1_000_000


def _iterated(step, *state: np.ndarray) -> np.ndarray:
    """step(n, *state) -> (state, relative change) for n = 1, 2, ... until each element's change is small; the first of the state, by element."""
    out, at = np.empty_like(state[0]), np.arange(len(state[0]))
    for n in range(1, STEPS):
        if not len(at):
            return out
        state, change = step(n, *state)
        done = ~(np.abs(change) >= CHANGE)
        if done.any():
            out[at[done]] = state[0][done]
            at, state = at[~done], tuple(v[~done] for v in state)
    raise ArithmeticError(f"no convergence in {STEPS} steps")


def _gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    def step(n, total, term, a, x):
        term = term * x / (a + n)
        total = total + term
        return (total, term, a, x), term / total

    return np.exp(a * np.log(x) - x - log_gamma(a)) * _iterated(step, 1 / a, 1 / a, a, x)


def _gamma_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    def step(i, h, b, c, d, a):
        k = -i * (i - a)
        b = b + 2
        d = 1 / np.where(np.abs(k * d + b) < 1e-300, 1e-300, k * d + b)
        c = np.where(np.abs(b + k / c) < 1e-300, 1e-300, b + k / c)
        return (h * d * c, b, c, d, a), d * c - 1

    b = x + 1 - a
    return 1 - np.exp(a * np.log(x) - x - log_gamma(a)) * _iterated(step, 1 / b, b, np.full(x.shape, 1e300), 1 / b, a)


def _gamma_expansion(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    m = (x - a) / a
    near = np.where(np.abs(m) < 0.15, m, 0.0)
    half = np.where(np.abs(m) < 0.15, near * near * sum((-near) ** k / (k + 2) for k in range(20)), m - np.log1p(m))
    eta = np.sign(m) * np.sqrt(2 * half)
    e = np.clip(eta, -0.4, 0.4)
    tail = sum(sum(c * e**j for j, c in enumerate(row)) / a**k for k, row in enumerate(_TEMME))
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-eta * np.sqrt(a / 2)) - np.exp(-a * half) / np.sqrt(2 * math.pi * a) * tail


def lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: the series below a + 1, the continued fraction above, each until it converges; for
    shapes above LARGE_SHAPE Temme's uniform expansion."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x <= 0, 0.0, np.where((x == np.inf) & (a > 0) & (a < np.inf), 1.0, np.nan))
    inside = (x > 0) & (x < np.inf) & (a > 0) & (a < np.inf)
    with np.errstate(all="ignore"):
        for f, part in ((_gamma_expansion, a > LARGE_SHAPE), (_gamma_series, (a <= LARGE_SHAPE) & (x < a + 1)), (_gamma_fraction, (a <= LARGE_SHAPE) & (x >= a + 1))):
            part = part & inside
            if part.any():
                out[part] = f(a[part], x[part])
    return out


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, until it converges."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    fix = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)

    def step(m, h, c, d, p, q, z):
        k = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / fix(1 + k * d), fix(1 + k / c)
        even = d * c
        k = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / fix(1 + k * d), fix(1 + k / c)
        return (h * even * d * c, c, d, p, q, z), even * d * c - 1

    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        d = 1 / fix(1 - (p + q) * z / (p + 1))
        h = _iterated(step, *(v.ravel() for v in (d, np.ones_like(z), d, p, q, z))).reshape(z.shape)
        out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def _one(f):
    @F.pandas_udf(T.DoubleType())
    def g(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float)))

    return g


def _two(f):
    @F.pandas_udf(T.DoubleType())
    def g(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), y.to_numpy(float)))

    return g


def _three(f):
    @F.pandas_udf(T.DoubleType())
    def g(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), y.to_numpy(float), z.to_numpy(float)))

    return g


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


#: Columns to columns. Arguments: lower_gamma_col(a, x); beta_col(a, b, x); the distributions' as named.
lgamma_col, digamma_col, erf_col = _one(log_gamma), _one(digamma), _one(_erf)
lower_gamma_col, beta_col = _two(lower_gamma), _three(beta_fraction)
normal_cdf = _three(lambda x, m, s: 0.5 * (1 + _erf((x - m) / (s * math.sqrt(2)))))
gamma_cdf = _three(lambda x, shape, scale: lower_gamma(shape, x / scale))
chi_square_tail = _two(lambda x, dof: 1 - lower_gamma(dof / 2, x / 2))
poisson_cdf = _two(lambda k, rate: 1 - lower_gamma(np.floor(k) + 1, rate))
student_two_tailed = _two(lambda t, dof: beta_fraction(dof / 2, np.full_like(dof, 0.5), dof / (dof + t * t)))
f_tail = _three(lambda x, d1, d2: 1 - beta_fraction(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)))
binomial_tail = _three(lambda k, n, p: np.where(k <= 0, 1.0, beta_fraction(np.maximum(k, 1), n - np.maximum(k, 1) + 1, p)))
