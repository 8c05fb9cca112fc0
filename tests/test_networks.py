"""Explanations, EM over whole networks, mixed networks: against sums over all assignments."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import mixed_networks as mixed
from cladeframe.operators import networks

SIZES = {"a": 2, "b": 3, "h": 2, "c": 2}
FAMILIES = {"h": ["h"], "a": ["h", "a"], "b": ["h", "a", "b"], "c": ["b", "c"]}


def _tables(spark, seed=1):
    rng, arrays, tables = np.random.default_rng(seed), {}, {}
    for v, fam in FAMILIES.items():
        p = rng.random([SIZES[x] for x in fam]) + 0.1
        arrays[v] = p / p.sum(axis=-1, keepdims=True)
        rows = [(*map(int, i), float(np.log(arrays[v][i]))) for i in np.ndindex(*arrays[v].shape)]
        tables[v] = spark.createDataFrame(rows, ", ".join(f"{x} int" for x in fam) + ", lp double")
    return arrays, tables


def _joint(arrays, x):
    return math.prod(arrays[v][tuple(x[y] for y in fam)] for v, fam in FAMILIES.items())


def _all():
    for pick in itertools.product(*(range(n) for n in SIZES.values())):
        yield dict(zip(SIZES, pick))


@pytest.mark.parametrize("nominated,order,known", [(["a", "b", "h"], ["c"], {}), (["h", "c"], ["a", "b"], {}), (["b", "h"], ["a"], {"c": 1}), (["a", "b", "h", "c"], [], {})])
def test_explanation_is_the_best_of_all_assignments(spark, nominated, order, known):
    arrays, tables = _tables(spark)
    total = {}
    for x in _all():
        if all(x[k] == v for k, v in known.items()):
            key = tuple(x[v] for v in nominated)
            total[key] = total.get(key, 0) + _joint(arrays, x)
    best = max(total, key=total.get)
    got = networks.explanation(list(tables.values()), nominated, order, known).collect()
    assert len(got) == 1 and tuple(got[0][v] for v in nominated) == best and got[0].lp == pytest.approx(math.log(total[best]), abs=1e-9)


def test_explanation_without_any_chance_is_empty(spark):
    t = spark.createDataFrame([(0, float("-inf"))], "a int, lp double")
    assert networks.explanation([t], ["a"]).count() == 0
    tie = spark.createDataFrame([(1, 0.0), (0, 1e-12)], "a int, lp double")
    assert networks.explanation([tie], ["a"]).first().a == 0


@pytest.mark.parametrize("limit", [256, 1])
def test_em_over_a_network_is_that_of_all_completions(spark, monkeypatch, limit):
    monkeypatch.setattr(networks, "JOINT_VALUES", limit)
    arrays, tables = _tables(spark, 3)
    rng = np.random.default_rng(7)
    rows = [tuple(None if rng.random() < 0.3 else int(rng.integers(SIZES[v])) for v in "abc") for _ in range(60)] + [(None, None, None)]
    got, seen = networks.learn(spark.createDataFrame(rows, "a int, b int, c int"), tables, 2, pseudo=0.1)
    want, likelihood = arrays, []
    for _ in range(2):
        counts, ll = {v: np.zeros_like(x) for v, x in want.items()}, 0.0
        for row in rows:
            fits = [x for x in _all() if all(o is None or x[v] == o for v, o in zip("abc", row))]
            w = np.array([_joint(want, x) for x in fits])
            ll += math.log(w.sum())
            for x, p in zip(fits, w / w.sum()):
                for v, fam in FAMILIES.items():
                    counts[v][tuple(x[y] for y in fam)] += p
        likelihood.append(ll)
        want = {v: (n + 0.1) / (n + 0.1).sum(axis=-1, keepdims=True) for v, n in counts.items()}
    assert seen == pytest.approx(likelihood, abs=1e-8)
    for v, fam in FAMILIES.items():
        assert {tuple(r[x] for x in fam): math.exp(r.lp) for r in got[v].collect()} == pytest.approx({tuple(map(int, i)): want[v][i] for i in np.ndindex(*want[v].shape)}, abs=1e-9)


def test_em_without_rows_and_likelihood_never_falls(spark):
    _, tables = _tables(spark, 5)
    none = spark.createDataFrame([], "a int, b int, c int")
    got, seen = networks.learn(none, tables, 1)
    assert seen == [0] and {tuple(r) for r in got["a"].collect()} == {tuple(r) for r in tables["a"].collect()}
    rows = spark.createDataFrame([(1, 0, 1), (1, 0, None), (0, 2, 0), (0, None, 0)] * 5, "a int, b int, c int")
    seen = networks.learn(rows, tables, 4)[1]
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))


def test_noisy_or_learnt_from_causes(spark):
    rng, truth, leak = np.random.default_rng(2), [0.8, 0.3], 0.1
    rows = []
    for _ in range(4000):
        on = rng.random(2) < 0.5
        fails = (1 - leak) * math.prod(1 - s for s, x in zip(truth, on) if x)
        rows.append((bool(on[0]), bool(on[1]), bool(rng.random() > fails)))
    got_leak, got, seen = networks.learn_noisy_or(spark.createDataFrame([*rows, (None, True, True)], "x boolean, y boolean, z boolean"), "z", ["x", "y"], 60)
    assert got_leak == pytest.approx(leak, abs=0.04) and got == pytest.approx(truth, abs=0.05)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))
    table = {(r.x, r.y, r.z): math.exp(r.lp) for r in networks.noisy_or_table(spark, "z", ["x", "y"], 0.1, truth).collect()}
    assert table[(True, True, False)] == pytest.approx(0.9 * 0.2 * 0.7) and len(table) == 8
    assert networks.learn_noisy_or(spark.createDataFrame([], "x boolean, z boolean"), "z", ["x"], 2)[0] == 0.1


def _normal(x, m, v):
    return math.exp(-((x - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v)


def test_mixed_network_in_closed_form(spark):
    prior = {0: 0.3, 1: 0.7}
    x_given = {0: (1.0, 2.0), 1: (-1.0, 0.5)}
    y_given = {0: (0.5, 1.0, 2.0), 1: (0.0, 1.5, -1.0)}  # mean, variance, slope on x
    s = mixed.from_discrete(spark.createDataFrame([(k, math.log(p)) for k, p in prior.items()], "s int, lp double"))
    x = mixed.gaussian(spark.createDataFrame([(k, m, v) for k, (m, v) in x_given.items()], "s int, mean double, variance double"), "x")
    y = mixed.gaussian(spark.createDataFrame([(k, m, v, [b]) for k, (m, v, b) in y_given.items()], "s int, mean double, variance double, slopes array<double>"), "y", ("x",))
    every = mixed.product(mixed.product(s, x), y)
    assert every.scope == ("x", "y")
    # y given s is normal; x given s and y too.
    of_y = {k: (y_given[k][0] + y_given[k][2] * x_given[k][0], y_given[k][1] + y_given[k][2] ** 2 * x_given[k][1]) for k in prior}
    at = 1.3
    weight = {k: prior[k] * _normal(at, *of_y[k]) for k in prior}
    seen = mixed.observed(every, "y", at)
    got = {r.s: r.p for r in mixed.posterior(seen, "s").collect()}
    assert got == pytest.approx({k: w / sum(weight.values()) for k, w in weight.items()}, abs=1e-12)
    gain = {k: y_given[k][2] * x_given[k][1] / of_y[k][1] for k in prior}
    mean = {k: x_given[k][0] + gain[k] * (at - of_y[k][0]) for k in prior}
    var = {k: x_given[k][1] - gain[k] * y_given[k][2] * x_given[k][1] for k in prior}
    listed = {r.s: (math.exp(r.lp), r.mean[0], r["cov"][0]) for r in mixed.components(seen).collect()}
    for k in prior:
        assert listed[k] == pytest.approx((weight[k], mean[k], var[k]), abs=1e-10)
    one = mixed.summed(seen, []).first()
    p = {k: w / sum(weight.values()) for k, w in weight.items()}
    m = sum(p[k] * mean[k] for k in p)
    assert (math.exp(one.lp), one.mean[0], one["cov"][0]) == pytest.approx((sum(weight.values()), m, sum(p[k] * (var[k] + mean[k] ** 2) for k in p) - m * m), abs=1e-10)
    rows = spark.createDataFrame([("u", 1.3), ("v", -2.0), ("w", None)], "id string, seen double")
    by = mixed.posterior(mixed.observed_rows(every, rows, "id", {"y": "seen"}), "s", ["id"])
    found = {(r.id, r.s): r.p for r in by.collect()}
    assert set(found) == {(i, k) for i in "uv" for k in prior} and found[("u", 0)] == pytest.approx(got[0], abs=1e-12)
    # Both real variables at once, by moments.
    both = mixed.summed(every, ["s"]).where("s = 1").first()
    cxx, cxy = x_given[1][1], y_given[1][2] * x_given[1][1]
    assert math.exp(both.lp) == pytest.approx(0.7) and list(both.mean) + list(both["cov"]) == pytest.approx([x_given[1][0], of_y[1][0], cxx, cxy, cxy, of_y[1][1]], abs=1e-9)
    # Nothing is said of the real variable: no integral.
    vague = mixed.Mixed(spark.createDataFrame([(0, 0.0, [0.0], [0.0])], "s int, g double, h array<double>, k array<double>"), ("x",))
    assert mixed.integrated(vague, "x").rows.first().g is None and mixed.components(vague).first().lp is None
