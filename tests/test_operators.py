import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import sequences, special, vectors
from cladeframe.operators import factors, graphs, intervals, learning, reconstruction, statistics, tables, trees
from cladeframe.plans import models
from cladeframe.plans.tree import newick, parse


def test_factor_join_order_takes_the_smallest_result_first():
    assert factors.join_order([{"a": 10, "b": 10}, {"b": 10, "c": 2}, {"c": 2}]) == [(1, 2), (0, 3)]


def test_elimination_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((2, 3)), rng.random((3, 2))
    fx = spark.createDataFrame([(i, j, float(np.log(x[i, j]))) for i in range(2) for j in range(3)], "a int, b int, lp double")
    fy = spark.createDataFrame([(j, k, float(np.log(y[j, k]))) for j in range(3) for k in range(2)], "b int, c int, lp double")
    got = {(r.a, r.c): r.p for r in factors.posterior([fx, fy], ["b"]).collect()}
    want = x @ y / (x @ y).sum()
    assert all(abs(got[i, k] - want[i, k]) < 1e-12 for i in range(2) for k in range(2))
    best = {r.a: r.lp for r in factors.eliminate([fx, fy], ["b", "c"], maximise=True).collect()}
    assert all(abs(best[i] - np.log((x[i][:, None] * y).max())) < 1e-12 for i in range(2))


def test_newick_round_trip():
    t = parse("((a:1,b:2)x:0.5,c:3)root:0;")
    assert t.labels == ("root", "x", "a", "b", "c") and t.parents == (-1, 0, 1, 1, 0) and t.dists == (0.0, 0.5, 1.0, 2.0, 3.0)
    assert parse(newick(t)) == t
    assert parse("((a,b),c);").labels == ("N0", "N1", "a", "b", "c")
    with pytest.raises(ValueError):
        parse("((a,b)")


def test_models():
    m = models.yang()
    assert np.allclose(m.transition(0.0), np.eye(4)) and np.allclose(m.transition(0.7).sum(axis=1), 1)
    assert np.allclose(m.transition(0.3) @ m.transition(0.4), m.transition(0.7))
    assert abs(models.jc("ACGT").transition(0.5)[0, 0] - (0.25 + 0.75 * math.exp(-0.5))) < 1e-12
    assert np.allclose(models.with_gap(models.jc("ACGT"), 0.1, 0.2).transition(2.0).sum(axis=1), 1)


def _brute(tree, model, known):
    """All joint assignments of inner nodes: best one, and marginals of the root."""
    from itertools import product

    inner = [i for i, c in enumerate(tree.children) if c]
    k, table = len(model.alphabet), {}
    for states in product(range(k), repeat=len(inner)):
        s = dict(zip(inner, states)) | known
        p = model.freqs[s[0]]
        for i, parent in enumerate(tree.parents):
            if parent >= 0 and i in s:
                p *= model.transition(tree.dists[i])[s[parent], s[i]]
        table[states] = p
    return inner, table


def test_likelihood_matches_brute_force(spark):
    tree, model = parse("((a:0.1,b:0.9)x:0.4,(c:0.3,d:0.2)y:0.6)r:0;"), models.yang()
    states = dict(zip("abcd", "ACGA"))
    sites = spark.createDataFrame([(7, n, s) for n, s in states.items()], "site long, leaf string, state string")
    known = {tree.labels.index(n): model.alphabet.index(s) for n, s in states.items()}
    inner, table = _brute(tree, model, known)
    best = max(table, key=table.get)
    got = {r.node: r.state for r in reconstruction.joint(sites, tree, model).collect()}
    assert got == {tree.labels[i]: model.alphabet[s] for i, s in zip(inner, best)}
    for node in ("r", "x"):
        at = inner.index(tree.labels.index(node))
        want = [sum(p for s, p in table.items() if s[at] == i) for i in range(4)]
        m = {r.state: r for r in reconstruction.marginal(sites, tree, model, node).collect()}
        assert all(abs(m[c].p - w / sum(want)) < 1e-12 for c, w in zip(model.alphabet, want))
        assert abs(m["A"].log_likelihood - math.log(sum(want))) < 1e-10


def test_parsimony(spark):
    tree = parse("((a,b)x,(c,d)y)r;")
    sites = spark.createDataFrame([(1, n, s) for n, s in zip("abcd", ["A", "A", "C", None])] + [(2, n, None) for n in "abcd"], "site long, leaf string, state string")
    rows = reconstruction.parsimony(sites, tree).collect()
    assert {r.score for r in rows} == {1} and {r.site for r in rows} == {1}
    assert {(r.node, r.state) for r in rows if r.node in "xyr"} == {("x", "A"), ("r", "A"), ("r", "C"), ("y", "A"), ("y", "C")} - {("x", "C")}


def test_edge_parsimony_of_equal_sequences_is_their_path(spark):
    tree = parse("((a,b)x,c)r;")
    rows = [(n, p, s) for n in "abc" for p, s in enumerate(["A", None, "C"])]
    e = reconstruction.bidirectional_edge_parsimony(spark.createDataFrame(rows, "leaf string, pos long, sym string"), tree, 3).collect()
    assert {(r.node, r.from_pos, r.to_pos, r.recip) for r in e} == {(n, a, b, True) for n in "xr" for a, b in ((-1, 0), (0, 2), (2, 3))}


def test_graph_paths_and_dead_ends(spark):
    edges = spark.createDataFrame([("g", -1, 0, True, 1.0), ("g", 0, 1, True, 1.0), ("g", 0, 2, False, 0.1), ("g", 1, 2, True, 1.0), ("g", 1, 3, True, 1.0), ("g", 2, 4, True, 1.0)], "graph string, from_pos long, to_pos long, recip boolean, weight double")
    path = [r.pos for r in graphs.best_paths(edges, 4).orderBy("step").collect()]
    assert path == [-1, 0, 1, 2, 4]
    assert {(r.from_pos, r.to_pos) for r in graphs.nibbled(edges, 4).collect()} == {(-1, 0), (0, 1), (0, 2), (1, 2), (2, 4)}


def test_alignment_by_brute_force():
    def score(a, b):
        from functools import lru_cache

        @lru_cache(None)
        def f(i, j, k):
            if not i and not j:
                return 0.0
            best = -1e18
            if i and j:
                best = max(best, f(i - 1, j - 1, 0) + (1 if a[i - 1] == b[j - 1] else -1))
            if i:
                best = max(best, f(i - 1, j, 1) + _gap(i, j, 1))
            if j:
                best = max(best, f(i, j - 1, 2) + _gap(i, j, 2))
            return best

        return f(len(a), len(b), 0)

    def _gap(*_):
        return -2.0

    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = ("".join(rng.choice(list("AC"), rng.integers(0, 6))) for _ in range(2))
        got, x, y = learning.align(a, b, 1.0, -1.0, -2.0, -2.0)  # opening as extending: a linear cost
        assert abs(got - score(a, b)) < 1e-9 and x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)


def test_trees_and_integrity(spark):
    t = parse("((a:1,b:2)x:0.5,c:3)root:0;").rows(spark)
    assert {r.node: r.n_leaves for r in trees.leaf_counts(t).collect()} == {0: 3, 1: 2, 2: 1, 3: 1, 4: 1}
    names = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "name string")
    got = {(r.issue, r.name) for r in trees.integrity_issues(t, names).collect()}
    assert got == {("duplicate in alignment", "b"), ("missing in tree", "z"), ("missing in alignment", "c")}


def test_special_functions():
    x = np.array([0.1, 0.5, 1.0, 3.3, 20.0])
    assert np.allclose(special.log_gamma(x), [math.lgamma(v) for v in x])
    assert np.allclose(special.digamma(np.array([1.0])), -0.5772156649015329)
    assert np.allclose(special.lower_gamma(np.ones(5), x), 1 - np.exp(-x))
    assert np.allclose(special.beta_fraction(np.array(2.0), np.array(3.0), np.array(0.4)), 6 * 0.4**2 - 8 * 0.4**3 + 3 * 0.4**4)


def test_incomplete_gamma_and_beta_of_large_arguments():
    from decimal import Decimal, localcontext

    def poisson_sum(n, x):
        """Exact P(n, x) for whole n: one less the sum of the first n Poisson terms."""
        with localcontext(prec=40):
            x = Decimal(x)
            term = total = Decimal(1)
            for k in range(1, n):
                term = term * x / k
                total += term
            return float(1 - total * (-x).exp())

    for n, xs in ((900, (800, 900, 901, 1000)), (9_999, (9_800, 9_999, 10_000, 10_200)), (100_000, (99_000, 100_000, 100_500)), (1_000_000, (999_000, 1_000_000))):
        for x in xs:
            want = poisson_sum(n, x)
            assert math.isclose(special.lower_gamma(np.array([n]), np.array([x]))[0], want, rel_tol=1e-10), (n, x)
    low, high = special.lower_gamma(np.full(2, special.LARGE_SHAPE), np.full(2, 1e4)), special.lower_gamma(np.full(2, np.nextafter(special.LARGE_SHAPE, 2e4)), np.full(2, 1e4))
    assert np.allclose(low, high, rtol=1e-10, atol=0)
    edge = special.lower_gamma(np.array([2.0, 2.0, 2.0, 1e5, 1e5, np.nan, 0.0]), np.array([0.0, -1.0, np.inf, 1.0, 1e9, 1.0, 1.0]))
    assert edge[:5].tolist() == [0, 0, 1, 0, 1] and np.isnan(edge[5:]).all()
    assert np.allclose(special.beta_fraction(np.array([1e5, 1e6, 2.0, 2.0]), np.array([1e5, 1e6, 3.0, 3.0]), np.array([0.5, 0.5, 0.0, 1.0])), [0.5, 0.5, 0, 1], rtol=1e-7)


def test_poisson_log_likelihood_of_large_counts(spark):
    counts = {"a": [171, 3, 3, 0, 100_000], "b": [2, 2, 5]}
    d = spark.createDataFrame([*((g, k) for g, v in counts.items() for k in v), ("b", None), ("c", None)], "g string, k long")
    got = {r.g: r for r in statistics.poisson_log_likelihood(d, "k", ["g"]).collect()}
    for g, v in counts.items():
        rate = sum(v) / len(v)
        want = sum(k * math.log(rate) - rate - math.lgamma(k + 1) for k in v)
        assert got[g].rate == rate and math.isclose(got[g].log_likelihood, want, rel_tol=1e-12)
    assert got["c"].rate is None and got["c"].log_likelihood is None


def test_vectors_and_sequences(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "x array<double>, y array<double>")
    r = d.select(vectors.kl_divergence(F.col("x"), F.col("y")).alias("kl"), vectors.distance(F.col("x"), F.col("y")).alias("d"), vectors.log_sum_of_logs(F.lit(float("-inf")), F.lit(-2.0)).alias("l")).first()
    assert r.kl == float("inf") and abs(r.d - 2**0.5) < 1e-12 and r.l == -2.0
    s = spark.range(1).select(sequences.merged_range(F.lit("7.2-7.5")).alias("m"), sequences.merged_range(F.lit("a-b")).alias("t"), sequences.word_key(F.lit("CA"), "ACGT").alias("k"), sequences.null_token(F.lit("None")).alias("n")).first()
    assert abs(float(s.m) - 7.35) < 1e-12 and s.t == "a-b-" and s.k == 1 and s.n is None


def test_intervals(spark):
    d = spark.createDataFrame([("g", 1, 4), ("g", 3, 6), ("g", 6, 8), ("g", 20, 21)], "g string, lo long, hi long")
    assert {(r.lo, r.hi, r.n) for r in intervals.merged(d, ["g"]).collect()} == {(1, 8, 3), (20, 21, 1)}
    assert {(r.lo, r.hi) for r in intervals.clipped(d, ["g"], 2).collect()} == {(3, 4), (6, 6)}
    pairs = intervals.overlap_join(d, d, 3, on=["g"]).where("lo < b_lo")
    assert {(r.lo, r.b_lo) for r in pairs.collect()} == {(1, 3), (3, 6)}


def test_gaussian_mixture_and_latent_classes(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(8, 1, 400)])
    w, m, v, _ = learning.gaussian_mixture(spark.createDataFrame([(float(t),) for t in x], "x double"), "x", 2)
    assert abs(sorted(m)[0]) < 0.3 and abs(sorted(m)[1] - 8) < 0.3 and abs(w[0] - 0.5) < 0.05
    rows = spark.createDataFrame([("a", "a", 50), ("b", "b", 50), ("a", "b", 3)], "u string, v string, n long")
    t = learning.latent_class(rows, ["u", "v"], 2, rounds=12).collect()
    best = {(r["class"], r.variable): r.value for r in sorted(t, key=lambda r: r.p)}
    assert {best[c, "u"] for c in (0, 1)} == {"a", "b"}


def test_recoded_likelihood_is_that_of_equal_rates(spark):
    tree = parse("((a:0.1,b:0.9)x:0.4,(c:0.3,d:0.2)y:0.6)r:0;")
    sites = spark.createDataFrame([(1, n, s) for n, s in zip("abcd", "ABBA")] + [(2, n, s) for n, s in zip("abcd", ["A", "B", None, "C"])], "site long, leaf string, state string")
    got = {(r.site, r.node): (r.state, round(r.log_likelihood, 9)) for r in reconstruction.joint_recoded(sites, tree).collect()}
    for site, states in ((1, ("A", "B")), (2, ("A", "B", "C"))):
        want = reconstruction.joint(sites.where(F.col("site") == site), tree, models.jc(states)).collect()
        assert all(abs(got[site, r.node][1] - r.log_likelihood) < 1e-6 for r in want) and {r.node: got[site, r.node][0] for r in want} == {r.node: r.state for r in want}


def test_simulation_follows_the_model(spark):
    tree, model = parse("(a:0.5,b:3)r:0;"), models.yang()
    rows = reconstruction.simulated(spark, tree, model, 4000, seed=3).groupBy("site").pivot("node", ["r", "a"]).agg(F.first("state")).groupBy("r", "a").count().collect()
    n = {r: sum(x["count"] for x in rows if x.r == r) for r in "ACGT"}
    for x in rows:
        p = model.transition(0.5)["ACGT".index(x.r), "ACGT".index(x.a)]
        assert abs(x["count"] / n[x.r] - p) < 5 * (p * (1 - p) / n[x.r]) ** 0.5 + 0.01


def test_segments_and_indel_lengths(spark):
    ll = [[0.0, -1.0]] * 5 + [[-1.0, 0.0]] * 4
    s = reconstruction.rate_segments(spark.createDataFrame([("x", i, v) for i, v in enumerate(ll)], "aln_id string, pos long, ll array<double>"), 6, 0.5).orderBy("start").collect()
    assert [(r.start, r.stop, r.category) for r in s] == [(0, 4, 0), (5, 8, 1)]
    presence = spark.createDataFrame([(n, i, int(v)) for n, row in (("p", "110011"), ("c", "101100")) for i, v in enumerate(row)], "node string, pos long, p int")
    got = {(r.kind, r.length): r.n for r in reconstruction.indel_lengths(presence, spark.createDataFrame([("c", "p")], "node string, parent string")).collect()}
    assert got == {("deletion", 1): 1, ("deletion", 2): 1, ("insertion", 2): 1}


def test_boolean_rbm_learns_which_units_go_together(spark):
    d = spark.createDataFrame([([1, 1, 0, 0],), ([0, 0, 1, 1],)] * 40, "v array<int>").coalesce(1)
    w, a, b = learning.boolean_rbm(d, "v", 2, rounds=60, rate=0.5)
    free = lambda v: -(np.array(v) @ a) - np.log1p(np.exp(np.array(v) @ w + b)).sum()
    assert max(free([1, 1, 0, 0]), free([0, 0, 1, 1])) < min(free([1, 0, 1, 0]), free([0, 1, 0, 1]))


def test_simple_indel_coding(spark):
    tree = parse("((a,b)x,(c,d)y)r;")
    rows = [(n, i, None if s == "-" else s) for n, seq in (("a", "A--C"), ("b", "A--C"), ("c", "ACGC"), ("d", "---C")) for i, s in enumerate(seq)]
    al = spark.createDataFrame(rows, "leaf string, pos long, sym string")
    coded = {(r.leaf, r.lo, r.hi): r.state for r in reconstruction.simple_indel_coding(al).collect()}
    assert coded == {("a", 1, 2): "1", ("b", 1, 2): "1", ("d", 1, 2): None, ("d", 0, 2): "1"}
    got = {(r.lo, r.node): r.state for r in reconstruction.indel_coding_parsimony(al, tree, 4).where("node = 'x'").collect()}
    assert got == {(1, "x"): "1", (0, "x"): "0"}


def test_likelihood_weighting_comes_near_the_exact_posterior(spark):
    from cladeframe.operators import sampling

    a = spark.createDataFrame([("x", 0.3), ("y", 0.7)], "a string, p double")
    b = spark.createDataFrame([("x", 1, 0.9), ("x", 2, 0.1), ("y", 1, 0.2), ("y", 2, 0.8)], "a string, b int, p double")
    c = spark.createDataFrame([(1, True, 0.6), (1, False, 0.4), (2, True, 0.1), (2, False, 0.9)], "b int, c boolean, p double")
    tables = [("a", [], a), ("b", ["a"], b), ("c", ["b"], c)]
    s = sampling.weighted_samples(spark, 20_000, tables, {"c": True})
    assert s.count() == 20_000
    got = {r.a: r.p for r in sampling.approximate_posterior(s, ["a"]).collect()}
    logs = [t.withColumn("lp", F.log("p")).drop("p") for _, _, t in tables]
    want = {r.a: r.p for r in factors.posterior(logs, ["b"], {"c": True}).collect()}
    assert all(abs(got[k] - want[k]) < 0.015 for k in want)


def test_marginal_keeps_groups_far_below_the_largest(spark):
    inf = float("inf")
    d = spark.createDataFrame([("a", 1, 0.0), ("b", 1, -1000.0), ("b", 2, -1000.0), ("c", 1, 5000.0), ("c", 2, 4999.0), ("z", 1, -inf), ("n", 1, None)], "g string, x int, lp double")
    got = {r.g: r.lp for r in factors.marginal(d, ["g"]).collect()}
    want = {"a": 0.0, "b": -1000 + math.log(2), "c": 5000 + math.log1p(math.exp(-1)), "z": -inf}
    assert set(got) == set(want) and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    x = d.where("g IN ('a', 'b')")
    total = sum(math.exp(r.lp) for r in factors.normalised(x).collect())
    assert abs(total - 1) < 1e-12 and len(factors.normalised(x).collect()) == 3


def test_products_without_a_shared_variable_are_checked(spark, monkeypatch):
    x, y = (spark.range(5).select(F.col("id").alias(c), F.lit(0.0).alias("lp")) for c in "ab")
    assert factors.product(x, y).count() == 25
    monkeypatch.setattr(factors, "PRODUCT_ROWS", 2)  # both too large to send: blocks of one of them
    assert sorted(map(tuple, factors.product(x, y).select("a", "b").collect())) == [(a, b) for a in range(5) for b in range(5)]


def test_degenerate_groups_give_null(spark):
    d = spark.createDataFrame([("one", 3.0, "p", 1), ("same", 2.0, "p", 1), ("same", 2.0, "p", 1), ("zero", 0.0, "p", 1), ("zero", 0.0, "p", 1)], "g string, v double, a string, n int")
    f = {r.g: r for r in statistics.fits(d, "v", ["g"]).collect()}
    assert f["one"].exp_rate == 1 / 3 and f["one"].gamma_shape is None and f["one"].power_alpha is None and f["same"].gamma_shape is None and "zero" not in f
    z = {r.g: r for r in statistics.zero_inflated_gamma(d, "v", ["g"]).collect()}
    assert z["zero"].zeros == 1 and z["zero"].shape is None and z["zero"].scale is None and z["one"].shape is None and z["one"].scale == 0
    assert statistics.chi_square(d, "a", "n").first().cramers_v is None
    assert statistics.mann_whitney(d, "v", "g", "one", "absent").first().z is None and statistics.mann_whitney(d, "v", "g", "same", "zero").first().z is not None
    assert statistics.ks_two_sample(d, "v", "g", "one", "absent").first().d is None and statistics.t_tests(d, "v", "g", "one", "same").first().welch_t is None
    al = spark.createDataFrame([("x", 0, "A"), ("x", 1, "C")], "leaf string, pos long, sym string")
    assert reconstruction.gap_statistics(al).first().mean_gap_length is None and reconstruction.gap_statistics(al).first().occupancy == 1
    assert reconstruction.gap_statistics(al.limit(0)).first().average_length is None
    r = spark.createDataFrame([([], [0.0, 0.0])], "e array<double>, z array<double>").select(vectors.mean(F.col("e")).alias("m"), vectors.variance(F.col("e")).alias("v"), vectors.cosine(F.col("z"), F.col("z")).alias("c"), vectors.unit(F.col("z")).alias("u")).first()
    assert r.m is None and r.v is None and r.c is None and r.u == [None, None]
    from cladeframe.operators import tables

    assert [r.density for r in tables.kernel_density(d.where("g = 'same'"), "v", [1.0, 2.0]).collect()] == [None, None]
    assert [r.density for r in tables.kernel_density(d.limit(0), "v", [1.0]).collect()] == [None]
    assert statistics.quantiles(d, "v", [0.0, 0.25, 0.5, 1.0]) == [0.0, 0.0, 2.0, 3.0]


def test_trees_of_any_depth(spark):
    n = 13
    chain = spark.createDataFrame([("t", i, i - 1 if i else None, f"n{i}", 1.0) for i in range(n)] + [("u", 0, None, "r", 0.0), ("u", 1, 0, "x", 2.0), ("u", 2, 99, "orphan", 2.0)], "tree string, node long, parent long, label string, dist double")
    got = {(r.tree, r.node): (r.depth, r.root_dist) for r in trees.with_depth(chain).collect()}
    assert got == {("t", i): (i, float(i)) for i in range(n)} | {("u", 0): (0, 0.0), ("u", 1): (1, 2.0), ("u", 2): (0, 0.0)}
    assert {(r.node, r.anc, r.steps) for r in trees.closure(chain).where("tree = 't'").collect()} == {(i, j, i - j) for i in range(n) for j in range(i + 1)}
    assert {r.n_leaves for r in trees.leaf_counts(chain).where("tree = 't'").collect()} == {1}
    top = spark.createDataFrame([("t", 5)], "tree string, node long")
    assert {(r.node, r.parent) for r in trees.subtree(chain, top).collect()} == {(5, None)} | {(i, i - 1) for i in range(6, n)}
    assert {(r.tree, r.node, r.parent) for r in trees.pruned(chain, top).collect()} == {("t", 6, None)} | {("t", i, i - 1) for i in range(7, n)} | {("u", 0, None), ("u", 1, 0), ("u", 2, None)}
    assert {r.tree: r.mean for r in trees.leaf_root_distribution(chain).collect()} == {"t": n - 1.0, "u": 1.0}
    with pytest.raises(ValueError):
        trees.with_depth(spark.createDataFrame([("t", 1, 2, 1.0), ("t", 2, 1, 1.0)], "tree string, node long, parent long, dist double"))
    long_end = spark.createDataFrame([("g", i, i + 1) for i in range(-1, 12)] + [("g", 2, 20)], "graph string, from_pos long, to_pos long")
    assert {(r.from_pos, r.to_pos) for r in graphs.nibbled(long_end, 20).collect()} == {(-1, 0), (0, 1), (1, 2), (2, 20)}


def test_scans_are_brute_force(spark):
    from cladeframe.operators.scans import scanned

    rng = np.random.default_rng(9)
    rows = [("hot" if rng.random() < 0.8 else [None, "b"][int(rng.integers(2))], i, None if rng.random() < 0.3 else int(rng.integers(-9, 9))) for i in rng.permutation(400).tolist()]
    d = spark.createDataFrame(rows, "g string, i int, v int").repartition(4)
    got = scanned(d, ["g"], ["i"], s=("sum", "v", True), b=("sum", "v", False), m=("max", "v", False), p=("last", "v", False), n=("next", "v", True)).collect()
    assert len(got) == 400
    for r in got:
        own = sorted((i, v) for g, i, v in rows if g == r.g)
        before, after = [v for i, v in own if i < r.i and v is not None], [v for i, v in own if i >= r.i and v is not None]
        assert (r.b, r.m, r.p, r.n) == (sum(before), max(before, default=None), before[-1] if before else None, after[0] if after else None) and r.s == r.b + (r.v or 0)


def test_interval_operators_are_brute_force(spark):
    rng = np.random.default_rng(4)
    make = lambda n: [(i, "h" if rng.random() < 0.7 else "k", (lo := int(rng.integers(0, 2000))), lo + int(rng.integers(0, 6) if rng.random() < 0.8 else rng.integers(0, 900))) for i in range(n)]
    a, b = make(60), make(40)
    q, s = (spark.createDataFrame(x, "id int, g string, lo long, hi long") for x in (a, b))
    pairs = sorted((r.id, r.b_id) for r in intervals.overlap_join(q, s, 4, on=["g"]).collect())
    assert pairs == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])

    def order(x, y):
        common = max(0, min(x[3], y[3]) - max(x[2], y[2]))
        union = x[3] - x[2] + y[3] - y[2] - common
        return max(0, x[2] - y[3], y[2] - x[3]), -(common / union if union > 0 else 0.0), y[2], y[3]

    got = {r.id: (r.gap, -r.jaccard, r.s_lo, r.s_hi) for r in intervals.closest(q, s, ["g"], "id").collect()}
    assert got == {x[0]: min(order(x, y) for y in b if y[1] == x[1]) for x in a}
    for g in "hk":
        cover = [sum(x[2] <= p <= x[3] for x in a if x[1] == g) for p in range(3000)]
        minus = [any(y[2] <= p <= y[3] for y in b if y[1] == g) for p in range(3000)]
        for found, inside in ((intervals.clipped(q, ["g"], 2), [c >= 2 for c in cover]), (intervals.difference(q, s, ["g"]), [c > 0 and not m for c, m in zip(cover, minus)])):
            have = sorted((r.lo, r.hi) for r in found.where(F.col("g") == g).collect())
            assert [p for p in range(3000) if inside[p]] == [p for lo, hi in have for p in range(lo, hi + 1)]
            assert all(lo2 > hi + 1 for (_, hi), (lo2, _) in zip(have, have[1:]))


def test_precluded_edges(spark):
    e = [(-1, 0), (0, 3), (1, 2), (2, 5), (3, 4), (0, 1)]
    d = spark.createDataFrame([("g", *x) for x in e], "graph string, from_pos long, to_pos long")
    chosen = d.where("from_pos = 0 AND to_pos = 3")
    assert {(r.from_pos, r.to_pos) for r in graphs.precluded(d, chosen).collect()} == {(a, b) for a, b in e if 0 < a < 3 or 0 < b < 3}


def test_zero_weights_and_constant_columns_give_null(spark):
    d = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 0.0), ("b", "x", 3.0), ("b", "y", 1.0)], "p string, c string, w double")
    shares = statistics.conditional_probabilities(d.withColumnRenamed("p", "parent"), "c", ["parent"], F.col("w")).collect()
    assert {(r.parent, r.c): r.p for r in shares} == {("a", "x"): None, ("a", "y"): None, ("b", "x"): 0.75, ("b", "y"): 0.25}
    flat = spark.createDataFrame([(1, k) for k in range(5)], "x int, y int")
    assert tables.kendall(flat, "x", "y").first().tau is None and tables.kendall(flat.limit(0), "x", "y").first().tau is None
    zeros = spark.createDataFrame([("z", 0), ("z", 0)], "g string, k int")
    assert [(r.rate, r.log_likelihood) for r in statistics.poisson_log_likelihood(zeros, "k", ["g"]).collect()] == [(0.0, 0.0)]


def test_kendall_counts_all_pairs(spark):
    import random

    r = random.Random(5)
    rows = [(r.choice([None, *range(9)]), r.random() if r.random() < 0.7 else 0.5) for _ in range(150)]
    full = [x for x in rows if None not in x]
    sign = lambda a, b: (a > b) - (a < b)
    pairs = [(sign(a[0], b[0]), sign(a[1], b[1])) for i, a in enumerate(full) for b in full[:i]]
    want = sum(p * q for p, q in pairs) / math.sqrt(sum(p != 0 for p, _ in pairs) * sum(q != 0 for _, q in pairs))
    assert tables.kendall(spark.createDataFrame(rows, "x int, y double"), "x", "y").first().tau == pytest.approx(want, abs=1e-12)


def test_primes_of_any_size(spark):
    from cladeframe.functions.distributions import is_prime

    prime = [2, 37, 41, 1681 + 12, 2**31 - 1, 2**61 - 1, 9223372036854775783]
    other = [-7, 0, 1, 1681, 3215031751, 2**61 + 1, 3037000493**2, 9223372036854775807, 341550071728321]
    d = spark.createDataFrame([(n,) for n in [*prime, *other, None]], "n long")
    assert {r.n: r.p for r in d.select("n", is_prime(F.col("n")).alias("p")).collect()} == {**dict.fromkeys(prime, True), **dict.fromkeys(other, False), None: None}


def test_smoothed_probabilities_in_blocks(spark, monkeypatch):
    d = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), (None, "a"), ("q", None)], "k string, v string")
    want = sorted(statistics.smoothed_probabilities(d, "v", ["k"], 0.5).collect(), key=str)
    assert len(want) == 12 and sum(r.p for r in want if r.k == "p") == pytest.approx(1)
    monkeypatch.setattr(statistics, "VALUES_EACH", 2)
    assert sorted(statistics.smoothed_probabilities(d, "v", ["k"], 0.5).collect(), key=str) == want


def test_t_tests_of_groups_beyond_the_cube_root_of_64_bits(spark):
    n = 2_150_000  # n * n * (n - 1) is more than a long holds
    d = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 4).cast("double").alias("v"))
    r = statistics.t_tests(d, "v", "g", "a", "b").first()
    assert r.dof == 2 * n - 2 and abs(r.welch_dof - r.dof) < 1e-3 and abs(r.f - 1) < 1e-9 and abs(r.t - r.welch_t) < 1e-6 * abs(r.t)


def test_closest_in_small_groups_takes_no_sweep(spark, monkeypatch):
    rng = np.random.default_rng(5)
    make = lambda n: spark.createDataFrame([(int(g), i, int(a), int(a + b)) for i, (g, a, b) in enumerate(zip(rng.integers(0, 9, n), rng.integers(0, 200, n), rng.integers(0, 12, n)))], "g long, k long, lo long, hi long")
    q, s = make(60), make(90)
    told = lambda: sorted(map(tuple, intervals.closest(q, s, ["g"], "k").collect()))
    monkeypatch.setattr(intervals, "SMALL_GROUP", 0)
    swept = told()
    monkeypatch.setattr(intervals, "SMALL_GROUP", 15)
    assert told() == swept  # some groups either way
    monkeypatch.setattr(intervals, "SMALL_GROUP", 150)
    monkeypatch.setattr(intervals, "scanned", None)
    assert told() == swept
