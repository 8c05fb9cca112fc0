"""Mixtures of exponential families, any number of them at once, and the choice between them by BIC; conjugate and mixed priors of tables.

Values are counted first, so a round of EM is one pass over distinct values and one row of sums, whatever the number of mixtures that are fitted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import special
from cladeframe.plans.session import checkpointed

#: Free parameters of a component besides its weight.
PARAMETERS = {"gaussian": 2, "gamma": 2, "exponential": 1}
#: Variances and the spread of logs are kept at least so large, so that no component shrinks to a point.
FLOOR = 1e-6
_LEAST = 1e-300


@dataclass
class Fit:
    """A mixture: weights and parameters (mean and variance; shape and scale; rate and 0) by component, and what the last round found."""

    family: str
    weights: list[float]
    first: list[float]
    second: list[float]
    log_likelihood: float = -math.inf
    n: float = 0.0
    history: list[float] = field(default_factory=list)

    @property
    def parameters(self) -> int:
        return len(self.weights) * (PARAMETERS[self.family] + 1) - 1

    @property
    def bic(self) -> float:
        """Twice the negative log-likelihood and the parameters times the log of the number of values: less is better."""
        return self.parameters * math.log(self.n) - 2 * self.log_likelihood if self.n else math.inf


def _density(family: str, a: float, b: float, x: Column, lx: Column) -> Column:
    """The log density of a component at x."""
    if family == "gaussian":
        return -(x - a) * (x - a) / (2 * b) - 0.5 * math.log(2 * math.pi * b)
    if family == "gamma":
        return (a - 1) * lx - x / b - (a * math.log(b) + math.lgamma(a))
    return math.log(a) - a * x


def _refit(family: str, n: float, sx: float, sxx: float, sl: float) -> tuple[float, float]:
    m = sx / n
    if family == "gaussian":
        return m, max(FLOOR, sxx / n - m * m)
    if family == "gamma":
        s = max(FLOOR, math.log(max(m, _LEAST)) - sl / n)
        shape = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)  # the usual closed approximation of the maximum
        return shape, max(m, _LEAST) / shape
    return 1 / max(m, _LEAST), 0.0


def _begun(family: str, k: int, low: float, high: float, mean: float, var: float) -> Fit:
    """Components spread evenly over the values' range, all as wide as the values are."""
    at = [low + (high - low) * (i + 0.5) / k for i in range(k)]
    var = max(FLOOR, var)
    if family == "gaussian":
        return Fit(family, [1 / k] * k, at, [var] * k)
    if family == "gamma":
        return Fit(family, [1 / k] * k, [max(m, FLOOR) ** 2 / var for m in at], [var / max(m, FLOOR) for m in at])
    return Fit(family, [1 / k] * k, [1 / max(m, FLOOR) for m in at], [0.0] * k)


def fit_all(df: DataFrame, value: str, kinds: list[tuple[str, int]], rounds: int) -> list[Fit]:
    """A fit of each kind (family, number of components) after ``rounds`` of EM, all in the same passes; ``log_likelihood`` is of the parameters that it ends with.

    Null, NaN and infinite values are left out, and for gamma and exponential mixtures all fits leave out what isn't above 0, so that they stay
    comparable. A component that nothing belongs to keeps its parameters. Without values the fits stay as they begin, with infinite BIC.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(x.alias("x"))
    if any(f != "gaussian" for f, _ in kinds):
        rows = rows.where("x > 0")
    counts = checkpointed(rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n")))
    s = counts.agg(F.min("x"), F.max("x"), F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("x") * F.col("x")), F.sum("n")).first()
    if s[4] is None:
        return [_begun(f, k, 0.0, 1.0, 0.5, 1.0) for f, k in kinds]
    mean = s[2] / s[4]
    fits = [_begun(f, k, s[0], s[1], mean, s[3] / s[4] - mean * mean) for f, k in kinds]
    for done in range(rounds + 1):
        col, lx = F.col("x"), F.log(F.greatest("x", F.lit(_LEAST)))
        out, names = counts, []
        for j, fit in enumerate(fits):
            parts = [math.log(max(w, _LEAST)) + _density(fit.family, a, b, col, lx) for w, a, b in zip(fit.weights, fit.first, fit.second)]
            out = out.withColumn(f"l{j}", F.array(*parts)).withColumn(f"t{j}", F.array_max(f"l{j}"))
            top = F.col(f"t{j}")
            out = out.withColumn(f"z{j}", top + F.log(reduce(lambda p, q: p + q, (F.exp(F.col(f"l{j}")[i] - top) for i in range(len(parts))))))
            names.append(F.sum(F.col("n") * F.col(f"z{j}")))
            for i in range(len(parts)):
                r = F.col("n") * F.exp(F.col(f"l{j}")[i] - F.col(f"z{j}"))
                names += [F.sum(r), F.sum(r * col), F.sum(r * col * col), F.sum(r * lx)]
        got = list(out.agg(*names).first())
        for fit in fits:
            fit.log_likelihood, fit.n = got.pop(0), s[4]
            fit.history.append(fit.log_likelihood)
            for i in range(len(fit.weights)):
                n, sx, sxx, sl = (got.pop(0) for _ in range(4))
                if done < rounds:
                    fit.weights[i] = n / s[4]
                    if n > 1e-9:
                        fit.first[i], fit.second[i] = _refit(fit.family, n, sx, sxx, sl)
    return fits


def best(fits: list[Fit]) -> Fit:
    """The fit of least BIC; of equally good ones the first."""
    return min(fits, key=lambda f: f.bic)


def fit_table(spark, fits: list[Fit]) -> DataFrame:
    """family, components, component, weight, first, second, log_likelihood, bic, chosen."""
    pick = best(fits)
    data = [(f.family, len(f.weights), i, f.weights[i], f.first[i], f.second[i], f.log_likelihood, f.bic, f is pick) for f in fits for i in range(len(f.weights))]
    return spark.createDataFrame(data, "family string, components int, component int, weight double, first double, second double, log_likelihood double, bic double, chosen boolean")


# --- priors

def gaussian_mean_posterior(df: DataFrame, value: str, on: list[str], mean: float, variance: float, noise: float) -> DataFrame:
    """Mean and variance of each group's mean, after a normal prior, for values with a known variance ``noise``. A group without values has the prior."""
    s = df.groupBy(*on).agg(F.count(value).alias("n"), F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("s"))
    precision = 1 / variance + F.col("n") / noise
    return s.select(*on, "n", ((mean / variance + F.col("s") / noise) / precision).alias("mean"), (1 / precision).alias("variance"))


def gamma_rate_posterior(df: DataFrame, value: str, on: list[str], shape: float, rate: float) -> DataFrame:
    """Shape, rate and mean of each group's Poisson rate after a gamma prior."""
    s = df.groupBy(*on).agg(F.count(value).alias("n"), F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("s"))
    return s.select(*on, (shape + F.col("s")).alias("shape"), (rate + F.col("n")).alias("rate"), ((shape + F.col("s")) / (rate + F.col("n"))).alias("mean"))


def dirichlet_mixture_posterior(counts: DataFrame, on: list[str], child: str, n: str, weights: list[float], alphas: list[dict]) -> DataFrame:
    """on, child, p: each group's table after a mixture of Dirichlet priors. ``counts``: groups, values and how often (``n``); ``alphas``: by component, the pseudo-counts by value,
    which list all values. A group's counts say how far each component speaks for it; its table is their mean by that. Values that no component lists don't count."""
    values = sorted({v for a in alphas for v in a})
    cells = [F.coalesce(F.sum(F.when(F.col(child) == F.lit(v), F.col(n).cast("double"))), F.lit(0.0)).alias(f"__n{i}") for i, v in enumerate(values)]
    g = counts.groupBy(*on).agg(*cells)
    total = sum((F.col(f"__n{i}") for i in range(len(values))), F.lit(0.0))
    for m, (w, a) in enumerate(zip(weights, alphas)):
        mass = sum(a.get(v, 0.0) for v in values)
        lp: Column = F.lit(math.log(max(w, _LEAST)) + math.lgamma(mass)) - special.lgamma_col(total + mass)
        for i, v in enumerate(values):
            if (x := a.get(v, 0.0)) > 0:
                lp = lp + special.lgamma_col(F.col(f"__n{i}") + x) - math.lgamma(x)
            else:
                lp = F.when(F.col(f"__n{i}") > 0, float("-inf")).otherwise(lp)  # such a component can't have given this value
        g = g.withColumn(f"__l{m}", lp)
    top = F.greatest(*(F.col(f"__l{m}") for m in range(len(alphas)))) if len(alphas) > 1 else F.col("__l0")
    share = [F.exp(F.col(f"__l{m}") - top) for m in range(len(alphas))]
    said = sum(share, F.lit(0.0))
    p = [sum((share[m] * (F.col(f"__n{i}") + a.get(v, 0.0)) / (total + sum(a.values())) for m, a in enumerate(alphas)), F.lit(0.0)) / said for i, v in enumerate(values)]
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), x.alias("p")) for v, x in zip(values, p)))).alias("__x")
    return g.select(*on, each).select(*on, F.col("__x.v").alias(child), F.col("__x.p").alias("p"))
