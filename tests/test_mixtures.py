"""Mixtures against a plain EM, the choice by BIC, priors, and blanket sampling against exact sums."""

import itertools
import math
import random

import numpy as np
import pytest

from cladeframe.operators import gibbs, mixtures


def test_components_are_chosen_by_bic(spark):
    rng = np.random.default_rng(4)
    two = np.concatenate([rng.normal(-4, 1, 700), rng.normal(5, 1, 300)])
    d = spark.createDataFrame([(float(x),) for x in two] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    fits = mixtures.fit_all(d, "v", [("gaussian", 1), ("gaussian", 2), ("gaussian", 3)], 30)
    pick = mixtures.best(fits)
    assert len(pick.weights) == 2 and sorted(pick.first) == pytest.approx([-4, 5], abs=0.3) and sorted(pick.weights) == pytest.approx([0.3, 0.7], abs=0.03)
    assert all(b >= a - 1e-6 for f in fits for a, b in zip(f.history, f.history[1:]))
    rows = mixtures.fit_table(spark, fits).collect()
    assert len(rows) == 6 and {r.components for r in rows if r.chosen} == {2}
    skewed = spark.createDataFrame([(float(x),) for x in rng.gamma(2.0, 3.0, 1500)] + [(-1.0,), (0.0,)], "v double")
    fits = mixtures.fit_all(skewed, "v", [("gaussian", 1), ("gamma", 1), ("exponential", 1)], 2)
    pick = mixtures.best(fits)
    assert pick.family == "gamma" and pick.n == 1500 and pick.first[0] == pytest.approx(2.0, abs=0.2)


def test_em_of_a_mixture_is_the_plain_one(spark):
    x = [1.0, 1.0, 2.0, 7.0, 8.5, 9.0]
    fit = mixtures.fit_all(spark.createDataFrame([(v,) for v in x], "v double"), "v", [("gaussian", 2)], 4)[0]
    mean = sum(x) / 6
    w, m, v = [0.5, 0.5], [1 + 8 * 0.25, 1 + 8 * 0.75], [sum((a - mean) ** 2 for a in x) / 6] * 2
    for _ in range(4):
        p = [[w[k] * math.exp(-((a - m[k]) ** 2) / (2 * v[k])) / math.sqrt(2 * math.pi * v[k]) for k in (0, 1)] for a in x]
        r = [[q[k] / sum(q) for k in (0, 1)] for q in p]
        n = [sum(q[k] for q in r) for k in (0, 1)]
        w = [c / 6 for c in n]
        m = [sum(q[k] * a for q, a in zip(r, x)) / n[k] for k in (0, 1)]
        v = [max(mixtures.FLOOR, sum(q[k] * a * a for q, a in zip(r, x)) / n[k] - m[k] ** 2) for k in (0, 1)]
    assert fit.weights == pytest.approx(w) and fit.first == pytest.approx(m) and fit.second == pytest.approx(v, abs=1e-9)
    none = mixtures.fit_all(spark.createDataFrame([], "v double"), "v", [("gaussian", 2)], 2)
    assert none[0].bic == math.inf and len(none[0].weights) == 2
    flat = mixtures.fit_all(spark.createDataFrame([(3.0,)] * 5, "v double"), "v", [("gaussian", 2), ("gamma", 1)], 2)
    assert all(math.isfinite(f.log_likelihood) for f in flat)


def test_priors(spark):
    d = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in mixtures.gaussian_mean_posterior(d, "v", ["g"], 0.0, 4.0, 2.0).collect()}
    assert (got["a"].mean, got["a"].variance) == pytest.approx((3 / 1.25, 1 / 1.25)) and (got["b"].mean, got["b"].variance) == (0.0, 4.0)
    rate = {r.g: r.mean for r in mixtures.gamma_rate_posterior(d, "v", ["g"], 1.0, 2.0).collect()}
    assert rate == pytest.approx({"a": 7 / 4, "b": 1 / 2})
    counts = {"u": {"x": 5, "y": 1}, "w": {"y": 2}, "z": {"q": 9}}
    weights, alphas = [0.7, 0.3], [{"x": 3.0, "y": 0.5}, {"x": 0.2, "y": 4.0}]
    n = spark.createDataFrame([(g, c, k) for g, by in counts.items() for c, k in by.items()], "g string, c string, k int")
    got = {(r.g, r.c): r.p for r in mixtures.dirichlet_mixture_posterior(n, ["g"], "c", "k", weights, alphas).collect()}
    for g, by in counts.items():
        c = {v: by.get(v, 0) for v in "xy"}
        total = sum(c.values())
        like = [w * math.exp(math.lgamma(sum(a.values())) - math.lgamma(sum(a.values()) + total) + sum(math.lgamma(a[v] + c[v]) - math.lgamma(a[v]) for v in "xy")) for w, a in zip(weights, alphas)]
        for v in "xy":
            assert got[(g, v)] == pytest.approx(sum(x / sum(like) * (c[v] + a[v]) / (total + sum(a.values())) for x, a in zip(like, alphas)))
    only = mixtures.dirichlet_mixture_posterior(n, ["g"], "c", "k", [1.0], [{"x": 1.0, "y": 0.0}]).where("g = 'u' AND c = 'x'").first().p
    assert only is None or math.isnan(only) or 0 <= only <= 1


def test_blanket_samples_come_to_the_exact_distribution(spark):
    rng = np.random.default_rng(6)
    scopes = {"ab": (2, 3), "bc": (3, 2), "cd": (2, 2), "a": (2,)}
    arrays = {s: rng.random(n) + 0.2 for s, n in scopes.items()}
    factors = [spark.createDataFrame([(*map(int, i), float(np.log(a[i]))) for i in np.ndindex(*a.shape)], ", ".join(f"{v} int" for v in s) + ", lp double") for s, a in arrays.items()]
    exact = {}
    for a, b, c in itertools.product(range(2), range(3), range(2)):
        p = arrays["ab"][a, b] * arrays["bc"][b, c] * arrays["cd"][c, 1] * arrays["a"][a]
        exact[(a, b)] = exact.get((a, b), 0) + p
    total = sum(exact.values())
    drawn = gibbs.samples(spark, factors, chains=300, discard=10, keep=40, known={"d": 1}, seed=3).cache()
    assert drawn.columns == ["chain", "sweep", "a", "b", "c"] and drawn.count() == 12_000
    got = {(r.a, r.b): r.p for r in gibbs.posterior(drawn, ["a", "b"]).collect()}
    assert got == pytest.approx({k: v / total for k, v in exact.items()}, abs=0.02)
    assert gibbs.convergence(drawn, "a", 1).first().spread == pytest.approx(1, abs=0.05)
    again = gibbs.samples(spark, factors, chains=300, discard=10, keep=40, known={"d": 1}, seed=3)
    assert again.exceptAll(drawn).count() == 0
    drawn.unpersist()
    assert gibbs.coloured([["a", "b"], ["b", "c"], ["d"]]) == [["b", "d"], ["a", "c"]]
    # Two halves that nothing connects: the measure tells.
    apart = spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.0)], "x int, y int, lp double")
    stuck = gibbs.convergence(gibbs.samples(spark, [apart], chains=20, discard=0, keep=20, seed=1), "x", 1).first().spread
    assert stuck is None or stuck > 1.5


def test_random_values_never_leave_the_tables(spark):
    r = random.Random(1)
    t = spark.createDataFrame([("p", "q", math.log(r.random())), ("p", "s", math.log(r.random()))], "u string, v string, lp double")
    assert {tuple(x) for x in gibbs.samples(spark, [t], chains=5, discard=1, keep=5).select("u", "v").distinct().collect()} <= {("p", "q"), ("p", "s")}
