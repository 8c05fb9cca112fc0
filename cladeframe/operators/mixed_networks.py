"""Networks of discrete and Gaussian variables: factors whose value is a weighted Gaussian, in canonical form.

A row holds, for one assignment of the discrete variables, exp(g + h'x - x'Kx / 2) over the factor's real variables. Products add; observing and integrating a
real variable are sums over a handful of numbers, all in the plan. Summing out a discrete variable gives a mixture, which is either listed, component by component, or
replaced by the Gaussian of the same moments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.operators.factors import VALUE, marginal

#: Tables of at most so many rows are sent to every row of evidence.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Mixed:
    """``rows``: discrete variables, g, h (a number for each of ``scope``), k (a number for each pair); no discrete variable may have one of these names."""

    rows: DataFrame
    scope: tuple[str, ...]

    @property
    def discrete(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("g", "h", "k")]


def _numbers(values: list) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")


def from_discrete(factor: DataFrame) -> Mixed:
    """A factor of discrete variables and ``lp``."""
    return Mixed(factor.select(*(c for c in factor.columns if c != VALUE), F.col(VALUE).alias("g"), _numbers([]).alias("h"), _numbers([]).alias("k")), ())


def gaussian(rows: DataFrame, child: str, parents: tuple[str, ...] = (), mean: str = "mean", variance: str = "variance", slopes: str = "slopes") -> Mixed:
    """child given real parents and, by row, discrete ones: normal around mean + slopes . parents. ``rows``: discrete variables, mean, variance (above 0), and slopes
    (an array, where there are real parents)."""
    m, v = F.col(mean).cast("double"), F.col(variance).cast("double")
    b = [F.lit(-1.0), *(F.col(slopes)[i] for i in range(len(parents)))]
    kept = [c for c in rows.columns if c not in (mean, variance, slopes)]
    h = [-m * x / v for x in b]
    k = [x * y / v for x in b for y in b]
    return Mixed(rows.where(v > 0).select(*kept, (-m * m / (2 * v) - 0.5 * F.log(2 * math.pi * v)).alias("g"), _numbers(h).alias("h"), _numbers(k).alias("k")), (child, *parents))


def _spread(f: Mixed, scope: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """h and k over a wider scope, 0 where the factor has no say."""
    at = {v: i for i, v in enumerate(f.scope)}
    n, zero = len(f.scope), F.lit(0.0)
    return [F.col("h")[at[v]] if v in at else zero for v in scope], [F.col("k")[at[v] * n + at[w]] if v in at and w in at else zero for v in scope for w in scope]


def product(x: Mixed, y: Mixed) -> Mixed:
    """Both factors at once: rows that agree in the shared discrete variables, exponents added. Without a shared discrete variable, the smaller side (at most
    BROADCAST_ROWS rows, checked) goes to the other's rows."""
    scope = (*x.scope, *(v for v in y.scope if v not in x.scope))
    shared = [c for c in x.discrete if c in y.discrete]
    sides = []
    for f, tag in ((x, "a"), (y, "b")):
        h, k = _spread(f, scope)
        sides.append(f.rows.select(*f.discrete, F.col("g").alias(f"__{tag}g"), _numbers(h).alias(f"__{tag}h"), _numbers(k).alias(f"__{tag}k")))
    a, b = sides
    if shared:
        both = a.join(b, shared)
    elif b.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = a.crossJoin(F.broadcast(b))
    elif a.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = b.crossJoin(F.broadcast(a))
    else:
        raise ValueError("factors without a shared discrete variable, both large: give them one")
    add = lambda p, q: F.zip_with(p, q, lambda s, t: s + t)
    kept = [*x.discrete, *(c for c in y.discrete if c not in shared)]
    return Mixed(both.select(*kept, (F.col("__ag") + F.col("__bg")).alias("g"), add("__ah", "__bh").alias("h"), add("__ak", "__bk").alias("k")), scope)


def observed(f: Mixed, variable: str, value: Column | float) -> Mixed:
    """The factor where a real variable has a value (of each row, if a column of it). A null value leaves no rows."""
    i, n = f.scope.index(variable), len(f.scope)
    x = value if isinstance(value, Column) else F.lit(float(value))
    rest = [j for j in range(n) if j != i]
    h, k = F.col("h"), F.col("k")
    g = F.col("g") + h[i] * x - 0.5 * k[i * n + i] * x * x
    kept = f.discrete
    return Mixed(f.rows.where(x.isNotNull()).select(*kept, g.alias("g"), _numbers([h[j] - k[j * n + i] * x for j in rest]).alias("h"), _numbers([k[j * n + m] for j in rest for m in rest]).alias("k")), tuple(f.scope[j] for j in rest))


def observed_rows(f: Mixed, seen: DataFrame, key: str, values: dict[str, str]) -> Mixed:
    """The factor for every row of evidence: ``key`` becomes a discrete variable, and the real variables have the values of the named columns of ``seen``. Discrete
    variables that ``seen`` has by name must agree."""
    told = seen.select(key, *values.values(), *(c for c in seen.columns if c in f.discrete and c != key))
    shared = [c for c in told.columns if c in f.discrete]
    if shared:
        both = told.join(f.rows, shared)
    elif f.rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = told.crossJoin(F.broadcast(f.rows))
    else:
        raise ValueError("the evidence has no variable of a large factor")
    out = Mixed(both, f.scope)
    for v, c in values.items():
        rest = observed(out, v, F.col(c))
        out = Mixed(rest.rows, rest.scope)
    return Mixed(out.rows.drop(*values.values()), out.scope)


def integrated(f: Mixed, variable: str) -> Mixed:
    """A real variable integrated out. Rows that say nothing of it (no precision) have no integral and become null."""
    i, n = f.scope.index(variable), len(f.scope)
    rest = [j for j in range(n) if j != i]
    h, k = F.col("h"), F.col("k")
    own = F.when(k[i * n + i] > 0, k[i * n + i])
    g = F.col("g") + 0.5 * (F.log(2 * math.pi / own) + h[i] * h[i] / own)
    return Mixed(f.rows.select(*f.discrete, g.alias("g"), _numbers([h[j] - k[j * n + i] * h[i] / own for j in rest]).alias("h"), _numbers([k[j * n + m] - k[j * n + i] * k[i * n + m] / own for j in rest for m in rest]).alias("k")), tuple(f.scope[j] for j in rest))


_MOMENTS = T.StructType([T.StructField("lp", T.DoubleType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_MOMENTS)
def _moments(g: pd.Series, h: pd.Series, k: pd.Series) -> pd.DataFrame:
    """Log mass, mean and covariance of canonical rows, all of a batch at once; null where the precision isn't positive definite."""
    if not len(g):
        return pd.DataFrame({"lp": [], "mean": [], "cov": []})
    n = len(h.iloc[0])
    hh, kk = np.stack(h.to_numpy()).astype(float), np.stack(k.to_numpy()).astype(float).reshape(-1, n, n)
    ok = np.isfinite(kk).all(axis=(1, 2)) & np.isfinite(hh).all(axis=1) & g.notna().to_numpy()
    values = np.linalg.eigvalsh(np.where(ok[:, None, None], kk, np.eye(n)))
    ok &= values[:, 0] > 0
    cov = np.linalg.inv(np.where(ok[:, None, None], kk, np.eye(n)))
    mean = np.einsum("rij,rj->ri", cov, hh)
    lp = g.to_numpy(float) + 0.5 * (n * math.log(2 * math.pi) - np.log(np.maximum(values, 1e-300)).sum(axis=1) + (hh * mean).sum(axis=1))
    pick = lambda x: [v.ravel().tolist() if o else None for v, o in zip(x, ok)]
    return pd.DataFrame({"lp": np.where(ok, lp, np.nan), "mean": pick(mean), "cov": pick(cov)}).astype({"lp": float}).where(lambda d: d.notna(), None)


def components(f: Mixed) -> DataFrame:
    """The mixture as a list: discrete variables, lp (log mass), mean and cov (arrays in the order of ``scope``) of each row."""
    if not f.scope:
        return f.rows.select(*f.discrete, F.col("g").alias(VALUE), _numbers([]).alias("mean"), _numbers([]).alias("cov"))
    return f.rows.withColumn("__m", _moments("g", "h", "k")).select(*f.discrete, F.col("__m.lp").alias(VALUE), "__m.mean", "__m.cov")


def summed(f: Mixed, keep: list[str]) -> DataFrame:
    """keep, lp, mean, cov: the discrete variables but ``keep`` summed out; the real ones as the Gaussian of the mixture's mean and covariance. Without real variables it is exact."""
    c, n = components(f), len(f.scope)
    total = marginal(c.select(*f.discrete, VALUE), keep).withColumnRenamed(VALUE, "__t")
    x = c.join(total, keep) if keep else c.crossJoin(F.broadcast(total))  # one row
    p = F.exp(F.col(VALUE) - F.col("__t"))
    mean = [F.sum(p * F.col("mean")[i]).alias(f"__m{i}") for i in range(n)]
    second = [F.sum(p * (F.col("cov")[i * n + j] + F.col("mean")[i] * F.col("mean")[j])).alias(f"__s{i * n + j}") for i in range(n) for j in range(n)]
    s = x.groupBy(*keep).agg(F.max("__t").alias(VALUE), *mean, *second)
    return s.select(*keep, VALUE, _numbers([F.col(f"__m{i}") for i in range(n)]).alias("mean"), _numbers([F.col(f"__s{i * n + j}") - F.col(f"__m{i}") * F.col(f"__m{j}") for i in range(n) for j in range(n)]).alias("cov"))


def posterior(f: Mixed, variable: str, given: list[str] | None = None) -> DataFrame:
    """given, variable, p: the distribution of a discrete variable, for every value of ``given`` (such as the evidence's key); real variables are integrated out."""
    for v in f.scope:
        f = integrated(f, v)
    lp = marginal(f.rows.select(*f.discrete, F.col("g").alias(VALUE)), [*(given or []), variable])
    total = marginal(lp, given or []).withColumnRenamed(VALUE, "__t")
    x = lp.join(total, given) if given else lp.crossJoin(F.broadcast(total))  # one row
    return x.select(*(given or []), variable, F.exp(F.col(VALUE) - F.col("__t")).alias("p"))
