"""Gapped columns, cheapest paths and plain distributions on small and awkward rows."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import distributions as D
from cladeframe.operators import graphs, peeling
from cladeframe.plans import models
from cladeframe.plans.tree import Tree

TREE = Tree(("r", "x", "a", "b", "c"), (-1, 0, 1, 1, 0), (0.0, 0.3, 0.1, 0.2, 0.4))
SITES = "site long, leaf string, state string"


def below(node, letter, column, mu, lam, model, full):
    """The chance of a column below a node with a letter (None: a gap), by recursion over one letter at a time."""
    kids = [i for i, p in enumerate(TREE.parents) if p == node]
    came = lambda i: lam / (mu + lam) * (1 - math.exp(-(mu + lam) * TREE.dists[i]))
    went = lambda i: mu / (mu + lam) * (1 - math.exp(-(mu + lam) * TREE.dists[i])) * (1 - came(i))
    empty = lambda i: all(column.get(TREE.labels[j]) is None for j in range(5) if TREE.labels[j] in "abc" and (j == i or TREE.parents[j] == i))
    if not kids:
        return 0.0 if letter is None else float(column.get(TREE.labels[node]) == letter)
    if letter is None:
        return sum(came(node) * sum(below(c, q, column, mu, lam, model, full) * full.freqs[j] for j, q in enumerate(model.alphabet)) + below(c, None, column, mu, lam, model, full) for c in kids if empty(c))
    i = model.alphabet.index(letter)
    return math.prod(sum(below(c, q, column, mu, lam, model, full) * full.transition(TREE.dists[c])[i, j] for j, q in enumerate(model.alphabet)) * (1 - came(c)) + empty(c) * went(c) for c in kids)


def brute(column, mu, lam, stay, model):
    full = models.with_gap(model, mu, lam)
    return math.log(below(0, None, column, mu, lam, model, full) + stay * sum(full.freqs[j] * below(0, q, column, mu, lam, model, full) for j, q in enumerate(model.alphabet)))


def test_every_column_of_three_leaves(spark):
    model = models.yang()
    columns = list(product((None, "A", "C", "T"), repeat=3))
    sites = spark.createDataFrame([(i, leaf, s) for i, c in enumerate(columns) for leaf, s in zip("abc", c)], SITES)
    got = {r.site: r.lp for r in peeling.column_likelihood(sites, TREE, model, 0.2, 0.1, 0.8).collect()}
    assert len(got) == 64
    for i, c in enumerate(columns):
        assert got[i] == pytest.approx(brute(dict(zip("abc", c)), 0.2, 0.1, 0.8, model), abs=1e-9)


def test_awkward_columns(spark):
    model = models.jc("AC")
    rows = [(1, "a", "A"), (1, "a", "A"), (1, "zz", "C"), (2, None, None), (3, "b", "?"), (None, "c", "C")]
    got = {r.site: r.lp for r in peeling.column_likelihood(spark.createDataFrame(rows, SITES), TREE, model, 0.2, 0.1, 0.8).collect()}
    assert got[1] == pytest.approx(brute({"a": "A"}, 0.2, 0.1, 0.8, model))
    assert got[2] == got[3] == pytest.approx(brute({}, 0.2, 0.1, 0.8, model))
    assert got[None] == pytest.approx(brute({"c": "C"}, 0.2, 0.1, 0.8, model))
    none = spark.createDataFrame([], SITES)
    assert not peeling.column_likelihood(none, TREE, model, 0.2, 0.1, 0.8).collect()
    assert peeling.alignment_likelihood(none, TREE, model, 0.2, 0.1, 0.8).first().lp == pytest.approx(peeling.length_terms(TREE, model, 0.2, 0.1, 0.8))
    assert peeling.column_likelihood(spark.createDataFrame([(1, x, "A") for x in "abc"], SITES), TREE, model, 0.0, 0.0, 0.8).first().lp < 0


def test_indel_rate_is_the_best_of_a_grid(spark):
    model = models.jc("AC")
    rows = [(i, leaf, None if (i * 7 + j * 3) % 4 == 0 else "AC"[i % 2]) for i in range(20) for j, leaf in enumerate("abc")]
    sites = spark.createDataFrame(rows, SITES)
    found = peeling.fit_indel_rate(sites, TREE, model, 0.8, 0.01, 3.0, 0.01)
    value = lambda r: sum(brute({leaf: s for i, leaf, s in rows if i == k}, r, r, 0.8, model) for k in range(20)) + peeling.length_terms(TREE, model, r, r, 0.8)
    assert value(found) >= max(value(r) for r in np.linspace(0.05, 3, 25)) - 1e-3


def test_optimal_edges_and_depths(spark):
    e = [(-1, 0, 1.0), (-1, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (0, 1, 0.5), (2, 4, 1.0), (3, 4, 1.0), (1, 3, 5.0)]
    df = spark.createDataFrame([("g", a, b, w, True) for a, b, w in e] + [("h", -1, 2, 1.0, True)], "graph string, from_pos long, to_pos long, weight double, recip boolean")
    got = graphs.optimal_edges(df, 4).collect()
    assert sorted((r.from_pos, r.to_pos) for r in got) == [(-1, 0), (-1, 1), (0, 2), (1, 2), (2, 4)] and {(r.graph, r.cost) for r in got} == {("g", 3.0)}
    assert {(r.graph, r.pos): (r.to_start, r.to_end) for r in graphs.depths(df, 4).collect()} == {("g", 0): (1, 2), ("g", 1): (1, 2), ("g", 2): (2, 1), ("g", 3): (2, 1), ("h", 2): (1, None)}
    assert not graphs.optimal_edges(df.where("false"), 4).collect()


def test_distributions_sum_to_one_and_meet_their_inverses(spark):
    k = spark.range(0, 400).withColumnRenamed("id", "k")
    sums = k.select(F.sum(D.geometric_mass(F.col("k"), 0.2)), F.sum(D.shifted_geometric_mass(F.col("k"), 0.2)), F.sum(D.hypergeometric_mass(F.col("k"), 60, 30, 25)), F.sum(D.power_law_mass(F.col("k"), 1.5, 50)), F.sum(D.bernoulli_mass(F.col("k"), 0.3))).first()
    assert list(sums) == pytest.approx([1] * 5)
    p = spark.range(1, 100).select((F.col("id") / 100).alias("p"))
    assert p.where(F.abs(D.logistic_cdf(D.logistic_quantile(F.col("p"), 1.0, 0.5), 1.0, 0.5) - F.col("p")) > 1e-9).count() == 0
    edge = spark.createDataFrame([(None, None), (-1, []), (2, [3.0, 1.0, 1.0, 3.0])], "k int, x array<double>")
    assert [tuple(r) for r in edge.select(D.geometric_mass(F.col("k"), 0.2), D.choose(F.lit(3), F.col("k")), D.is_prime(F.col("k")), D.mode(F.col("x"))).collect()] == [(None, None, None, None), (0.0, 0.0, False, None), (pytest.approx(0.128), 3.0, True, 1.0)]
    assert [r[0] for r in spark.range(30).where(D.is_prime(F.col("id"))).collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
