"""Annotation, pair hidden Markov model, mixtures, machines, repair and network files against brute force on small inputs."""

import itertools
import math

import numpy as np
import pytest

from cladeframe.operators import annotation, graphs, learning, pair_hmm
from cladeframe.plans import models
from cladeframe.plans.tree import parse
from cladeframe.sources import networks

TREE = parse("((a:0.4,b:0.9)x:0.3,c:0.7)r;")
MODEL = models.jc(("lo", "hi"))


def brute(values, means, variances):
    """Posterior of each node's state and the log-likelihood, over all assignments."""
    n, total = len(TREE.labels), {}
    for states in itertools.product(range(2), repeat=n):
        p = MODEL.freqs[states[0]]
        for i in range(1, n):
            p *= MODEL.transition(TREE.dists[i])[states[TREE.parents[i]], states[i]]
        for i, lab in enumerate(TREE.labels):
            if lab in values:
                v = variances[states[i]]
                p *= math.exp(-((values[lab] - means[states[i]]) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v)
        total[states] = p
    z = sum(total.values())
    return {lab: [sum(p for s, p in total.items() if s[i] == k) / z for k in range(2)] for i, lab in enumerate(TREE.labels)}, math.log(z)


def test_annotation_matches_brute_force(spark):
    rows = [(1, "a", 0.1), (1, "b", 2.9), (1, "b", 3.1), (1, "other", 7.0), (1, "c", None), (2, "a", None), (2, None, 1.0), (3, "c", float("nan")), (None, "a", 1.0)]
    values = spark.createDataFrame(rows, "site long, leaf string, value double")
    means, variances = [0.0, 3.0], [1.0, 0.5]
    got = {(r.site, r.node): r for r in annotation.annotated(values, TREE, MODEL, means, variances, weight=2.0).collect()}
    assert {s for s, _ in got} == {1, 2, 3} and len(got) == 15
    for site, told in ((1, {"a": 0.1, "b": 3.0}), (2, {}), (3, {})):
        want, _ = brute(told, means, variances)
        for node, p in want.items():
            r = got[site, node]
            mean = p[0] * means[0] + p[1] * means[1]
            sd = math.sqrt(sum(q * (v + m * m) for q, v, m in zip(p, variances, means)) - mean**2)
            assert r.state == ("lo" if p[0] >= p[1] - 1e-12 else "hi") and abs(r.p - max(p)) < 1e-9
            assert abs(r.mean - mean) < 1e-9 and abs(r.sd - sd) < 1e-9 and abs(r.upper - mean - 2 * sd) < 1e-9


def test_emissions_are_learned(spark):
    rng, rows = np.random.default_rng(5), []
    for site in range(300):
        state = {}
        for i, lab in enumerate(TREE.labels):
            p = MODEL.freqs if i == 0 else MODEL.transition(TREE.dists[i])[state[TREE.parents[i]]]
            state[i] = int(rng.random() < p[1] / sum(p))
            if lab in "abc":
                rows.append((site, lab, float(rng.normal([-2, 4][state[i]], [0.5, 1.0][state[i]]))))
    values = spark.createDataFrame(rows, "site long, leaf string, value double")
    means, variances, loglik = annotation.fit_emissions(values, TREE, MODEL)
    assert abs(means[0] + 2) < 0.2 and abs(means[1] - 4) < 0.2 and abs(variances[0] - 0.25) < 0.1 and abs(variances[1] - 1) < 0.3
    by = {}
    for s, lab, v in rows:
        by.setdefault(s, {})[lab] = v
    assert abs(loglik - sum(brute(x, means, variances)[1] for x in by.values())) < 1e-2 * abs(loglik)
    assert annotation.fit_emissions(values.limit(0), TREE, MODEL) == ([0.0, 0.0], [1e-3, 1e-3], 0.0)


def ways(a, b):
    """All alignments as lists of moves from the start."""
    if not a and not b:
        yield []
    for move, (i, j) in enumerate(((1, 1), (1, 0), (0, 1))):
        if len(a) >= i and len(b) >= j:
            for rest in ways(a[i:], b[j:]):
                yield [move, *rest]


@pytest.mark.parametrize("a,b", [("ACG", "AG"), ("A", ""), ("", ""), ("AAC", "CAAC")])
def test_pair_hmm_matches_all_alignments(a, b):
    model = pair_hmm.PairModel(open_gap=0.1, extend=0.3, end=0.05, same=0.7, symbols=4)
    t, posteriors, total, best = model.transitions(), np.zeros((len(a), len(b))), 0.0, -np.inf
    found = []
    for moves in ways(a, b):
        lp, state, i, j, paired = 0.0, 0, 0, 0, []
        for move in moves:
            lp += t[state, move] + (-math.log(4) if move else math.log(0.7 / 4 if a[i] == b[j] else 0.3 / 12))
            if move == 0:
                paired.append((i, j))
            state, i, j = move, i + (move != 2), j + (move != 1)
        p = math.exp(lp) * 0.05
        total += p
        best = max(best, p)
        found.append(paired)
        for x in paired:
            posteriors[x] += p
    got, lp = pair_hmm.pair_posteriors(a, b, model)
    assert abs(lp - math.log(total)) < 1e-9 and np.allclose(got, posteriors / total)
    score, x, y = pair_hmm.most_probable(a, b, model)
    assert abs(score - math.log(best)) < 1e-9 and x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
    sum_, x, y = pair_hmm.most_accurate(a, b, got)
    assert abs(sum_ - max(sum(got[q] for q in f) for f in found)) < 1e-9 and x.replace("-", "") == a and y.replace("-", "") == b


def test_pair_hmm_rows(spark):
    df = spark.createDataFrame([("ACGT", "ACT", 1), (None, "A", 2), ("ACGT", "ACT", 1)], "a string, b string, viterbi_a int")
    out = pair_hmm.hmm_alignments(df).collect()
    assert len(out) == 3 and {(r.a, r.viterbi_a, r.viterbi_b) for r in out} == {("ACGT", "ACGT", "AC-T"), (None, "-", "A")}
    assert pair_hmm.hmm_alignments(df.limit(0)).count() == 0


def test_dirichlet_mixture_separates_its_parts(spark):
    rng = np.random.default_rng(7)
    rows = [(rng.multinomial(40, rng.dirichlet([[20, 2, 2], [2, 2, 20]][i % 3 == 0])).tolist(),) for i in range(300)]
    df = spark.createDataFrame([*rows, (None,)], "c array<long>")
    weights, alpha, _ = learning.dirichlet_mixture(df, "c", 2, rounds=60)
    order = np.argsort(weights)
    shares = np.array(alpha)[order] / np.array(alpha)[order].sum(axis=1, keepdims=True)
    assert abs(weights[order[0]] - 1 / 3) < 0.05 and np.allclose(shares, [[1 / 12, 1 / 12, 10 / 12], [10 / 12, 1 / 12, 1 / 12]], atol=0.05)
    assert learning.dirichlet_mixture(df.limit(0), "c", 2)[0] == [0.5, 0.5]


def test_multinomial_machine_learns_its_patterns(spark):
    df = spark.createDataFrame([([0, 2],)] * 60 + [([1, 0],)] * 60 + [(None,)], "v array<int>")
    w, a, b = learning.multinomial_rbm(df, "v", values=3, hidden=4, rounds=60, rate=0.5)
    assert w.shape == (6, 4)

    def free(v):
        x = np.eye(3)[v].reshape(-1)
        return float(a @ x + np.logaddexp(0, x @ w + b).sum())

    assert min(free([0, 2]), free([1, 0])) > max(free([0, 0]), free([1, 2]), free([2, 1]))


def test_broken_graphs_are_repaired(spark):
    schema = "graph string, from_pos long, to_pos long, recip boolean"
    edges = spark.createDataFrame([("x", -1, 0, True), ("x", 1, 3, True), ("y", -1, 3, False)], schema)
    other = spark.createDataFrame([("x", -1, 3, True), ("y", -1, 0, True), ("z", -1, 3, True)], schema)
    assert sorted(map(tuple, graphs.repaired(edges, other, 3).collect())) == [("x", -1, 3, True), ("y", -1, 3, False)]


def test_network_file(spark, tmp_path):
    (tmp_path / "n.xml").write_text("""<bnet>
<def>
<var name="Wet" type="Boolean"/>
<var name="Sky" params="blue;light grey;" type="String"/>
</def>
<branchPoint type="CPT" var="Sky">
<params>
0.25, 0.75;
</params>
</branchPoint>
<branchPoint type="CPT" var="Wet">
<parent var="Sky"/>
<params>
0: 0.9, 1.0E-1; (light grey)
1: 0.5, 0.5; (blue)
</params>
</branchPoint>
</bnet>
""")
    v = {r.name: (r.type, r.states) for r in networks.read_variables(spark, str(tmp_path)).collect()}
    assert v == {"Wet": ("Boolean", []), "Sky": ("String", ["blue", "light grey"])}
    nodes = networks.read_nodes(spark, str(tmp_path))
    assert {r.variable: r.parents for r in nodes.collect()} == {"Sky": [], "Wet": ["Sky"]}
    rows = {(r.variable, r.row): (r.condition, r.numbers) for r in networks.table_rows(nodes).collect()}
    assert rows == {("Sky", 0): ([], [0.25, 0.75]), ("Wet", 0): (["light grey"], [0.9, 0.1]), ("Wet", 1): (["blue"], [0.5, 0.5])}
