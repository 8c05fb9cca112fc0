"""Network structure, fits over whole numbers and exact tests on small and awkward rows."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import expressions as X
from cladeframe.operators import graphs, lengths, structure, trees

EDGES = "net string, parent string, child string"
NODES = "net string, node string"


def edges(spark, text):
    return spark.createDataFrame([("n", *e.split(">")) for e in text.split()], EDGES)


def nodes(spark, text):
    return spark.createDataFrame([("n", x) for x in text.split()], NODES)


def names(df):
    return "".join(sorted(r.node for r in df.collect()))


def test_markov_blanket_and_ancestors(spark):
    e = edges(spark, "a>c b>c c>d e>d d>f c>d")
    rows = structure.markov_blanket(e, nodes(spark, "c c z")).collect()
    assert sorted((r.node, r.member) for r in rows) == [("c", "a"), ("c", "b"), ("c", "d"), ("c", "e")]
    assert names(structure.ancestors(e, nodes(spark, "d"))) == "abce"
    assert names(structure.relevant(e, nodes(spark, "d c"), nodes(spark, "c"))) == "abce"


def trails(parents, query, known):
    """Nodes at the end of an active trail, by listing all trails of a small network."""
    allv = sorted(set(parents) | {p for ps in parents.values() for p in ps})
    above = lambda v: set().union(*({p} | above(p) for p in parents.get(v, ()))) if parents.get(v) else set()
    converge = set(known).union(*(above(k) for k in known)) if known else set()
    links = {(a, b) for b, ps in parents.items() for a in ps}
    found = set(query)
    for n in range(2, len(allv) + 1):
        for t in itertools.permutations(allv, n):
            if t[0] not in query or t[0] in known or any((a, b) not in links and (b, a) not in links for a, b in zip(t, t[1:])):
                continue
            if all((m in converge) if (a, m) in links and (b, m) in links else m not in known for a, m, b in zip(t, t[1:], t[2:])):
                found.add(t[-1])
    return "".join(sorted(found))


@pytest.mark.parametrize("known", ["", "c", "d", "b", "a d"])
def test_d_connection_against_all_trails(spark, known):
    parents = {"c": "ab", "d": "c", "e": "b", "f": "e"}
    e = edges(spark, " ".join(f"{p}>{c}" for c, ps in parents.items() for p in ps))
    assert names(structure.d_connected(e, nodes(spark, "a"), nodes(spark, known))) == trails(parents, {"a"}, set(known.split()))


def test_topological_levels(spark):
    e = edges(spark, "a>b b>c a>c c>d x>d")
    assert {r.node: r.level for r in structure.topological_levels(e).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(ValueError):
        structure.topological_levels(edges(spark, "r>a a>b b>a"))


def test_structure_of_nothing_and_of_nulls(spark):
    none, q = spark.createDataFrame([("n", None, "a"), ("n", "a", None), (None, "a", "b")], EDGES), nodes(spark, "a")
    for e in (none, none.limit(0)):
        assert structure.markov_blanket(e, q).count() == structure.ancestors(e, q).count() == structure.topological_levels(e).count() == 0
        assert names(structure.d_connected(e, q, q.limit(0))) == "a"


def test_length_fits(spark):
    rows = [("a", k) for k in [1, 1, 1, 2, 3, 5]] + [("ones", 1), ("ones", 1), ("top", 4), ("top", 4), (None, 1), (None, 2)] + [("a", None), ("a", 0), ("a", -3)]
    got = {r.g: r for r in lengths.length_fits(spark.createDataFrame(rows, "g string, x int"), "x", ["g"]).collect()}
    a = got["a"]
    assert (a.n, a.top) == (6, 5) and a.rate / (1 - math.exp(-a.rate)) == pytest.approx(13 / 6)
    p = [k**-a.zipf for k in range(1, 6)]
    assert sum(w * math.log(k) for k, w in enumerate(p, 1)) / sum(p) == pytest.approx(math.log(30) / 6)
    assert a.zipf_ll == pytest.approx(sum(math.log(p[k - 1] / sum(p)) for k in [1, 1, 1, 2, 3, 5]))
    q = [((6 - k) / k) ** a.lavalette for k in range(1, 6)]
    assert a.lavalette_ll == pytest.approx(sum(math.log(q[k - 1] / sum(q)) for k in [1, 1, 1, 2, 3, 5]))
    assert a.rate_ll == pytest.approx(sum(k * math.log(a.rate) - a.rate - math.lgamma(k + 1) - math.log(1 - math.exp(-a.rate)) for k in [1, 1, 1, 2, 3, 5]))
    assert (got["ones"].rate, got["ones"].rate_ll, got["ones"].zipf) == (0.0, 0.0, None)
    assert got["top"].zipf is None and got["top"].lavalette is None and got[None].n == 2
    assert lengths.length_fits(spark.createDataFrame([], "g string, x int"), "x", ["g"]).count() == 0


def test_supports_in_parts(spark, monkeypatch):
    f = lambda k: -((k - 2.0) ** 2)
    whole = lengths._tilted(1000, 0.01, f)
    monkeypatch.setattr(lengths, "PART", 7)
    assert lengths._tilted(1000, 0.01, f) == pytest.approx(whole)


def test_fisher_exact(spark):
    rows = [("x", True, True)] * 3 + [("x", True, False)] + [("x", False, True)] + [("x", False, False)] * 3 + [("x", None, True), ("y", True, True)]
    got = {r.g: r for r in lengths.fisher_exact(spark.createDataFrame(rows, "g string, a boolean, b boolean"), F.col("a"), F.col("b"), ["g"]).collect()}
    x = got["x"]
    assert (x.n11, x.n12, x.n21, x.n22) == (3, 1, 1, 3)
    assert (x.p, x.less, x.greater, x.both) == pytest.approx((16 / 70, 69 / 70, 17 / 70, 34 / 70))
    assert (got["y"].p, got["y"].both) == pytest.approx((1, 1))


def test_latin_hypercube(spark):
    d = spark.createDataFrame([(k,) for k in [*range(50), 3, None]], "k int")
    got = lengths.latin_hypercube(d, "k", 3, 1).collect()
    assert sorted(r.k for r in got) == list(range(50))
    assert all(sorted(int(r[f"u{i}"] * 50) for r in got) == list(range(50)) for i in (1, 2, 3))
    assert got and sorted(got) == sorted(lengths.latin_hypercube(d.repartition(3), "k", 3, 1).collect())


def test_edge_rates_and_leaf_paths(spark):
    j = spark.createDataFrame([("g", "a", 0, 1), ("g", "b", 0, 2), ("g", "b", 0, 2)], "graph string, leaf string, from_pos int, to_pos int")
    n = spark.createDataFrame([("g", "a", 3), ("g", "b", 5)], "graph string, leaf string, n int")
    assert {r.to_pos: r.rate for r in graphs.edge_rates(j, n).collect()} == pytest.approx({1: 4 / 10, 2: 6 / 10})
    tree = spark.createDataFrame([("t", 0, None, 0.0), ("t", 1, 0, 1.0), ("t", 2, 1, 2.0), ("t", 3, 1, 3.0)], "tree string, node int, parent int, dist double")
    paths = trees.leaf_paths(tree)
    assert sorted((r.node, r.anc, r.dist) for r in paths.collect()) == [(2, 0, 0.0), (2, 1, 1.0), (2, 2, 2.0), (3, 0, 0.0), (3, 1, 1.0), (3, 3, 3.0)]
    twice = trees.with_leaf_paths(tree, paths.where("node = 2").withColumn("dist", F.col("dist") * 2))
    assert {r.node: r.dist for r in twice.collect()} == {0: 0.0, 1: 2.0, 2: 4.0, 3: 3.0}


def test_expressions_at_the_edges(spark):
    d = spark.createDataFrame([(-1.0, -1), (0.0, 0), (None, None)], "x double, k int")
    made = [X.weibull_density(F.col("x"), 1.5, 2), X.weibull_cdf(F.col("x"), 1.5, 2), X.weibull_quantile(F.col("x"), 1.5, 2), X.log_choose(F.lit(0), F.col("k")), X.negative_binomial_mass(F.col("k"), 2.0, 0.5), X.negative_binomial_cdf(F.col("k"), 2.0, 0.5), X.thin_plate_basis(F.col("x"), 2)]
    a, b, c = (tuple(r) for r in d.select(*made).collect())
    assert a == (0, 0, None, None, 0, 0, 0) and b[:4] == (0, 0, 0, pytest.approx(0)) and b[4:6] == pytest.approx((0.25, 0.25))
    nothing = X.c_divide(X.complex_number(F.col("x"), F.lit(1)), X.complex_number(F.lit(0), F.lit(0)))
    assert d.select(nothing["re"]).first()[0] is None


def test_rows_of_one_key_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(structure, "PIECE_ROWS", 10)
    many = spark.range(100).selectExpr("'n' AS net", "if(id < 95, 'hub', 'x') AS parent", "concat('c', id) AS child")
    dealt, hot = structure._dealt(many, ["net", "parent"])
    assert [tuple(r) for r in hot.collect()] == [("n", "hub", 10)]
    assert dealt.where("parent = 'hub'").groupBy("__piece").count().agg({"count": "max"}).first()[0] < 40
    few = spark.createDataFrame([("n", "hub")], "net string, parent string")
    assert structure._met(many, few, ["net", "parent"]).distinct().count() == 95
    assert structure._met(many, few, ["net", "parent"], "left_anti").count() == 5
