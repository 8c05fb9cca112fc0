"""Queries of network structure, fits over whole numbers, exact tests and plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import expressions as X
from cladeframe.operators import graphs, lengths, reconstruction, structure, trees
from cladeframe.plans.graph_queries import _ALIGNMENT, HOURS, _alignment
from cladeframe.plans.tree_queries import _UP, world


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network of sales: region, nation, customer, order in a chain; a segment is a customer's other parent, a priority an order's."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = lambda d, a, b: d.select(F.lit("sales").alias("net"), a.alias("parent"), b.alias("child"))
    n, c, o = (_t(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    return (
        edge(n, name("r", "n_regionkey"), name("n", "n_nationkey")).unionByName(edge(c, name("n", "c_nationkey"), name("c", "c_custkey"))).unionByName(edge(c, name("s", "c_mktsegment"), name("c", "c_custkey")))
        .unionByName(edge(o, name("c", "o_custkey"), name("o", "o_orderkey"))).unionByName(edge(o, name("p", "o_orderpriority"), name("o", "o_orderkey")))
    )


_SALES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 's' || c_mktsegment, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'p' || o_orderpriority, 'o' || o_orderkey FROM orders)"""
#: Known are customers in debt and orders in progress.
_KNOWN = "known AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0 UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P')"


def _known(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return c.unionByName(o).withColumn("net", F.lit("sales"))


def _some(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.range(1).select(F.lit("sales").alias("net"), F.explode(F.array(*map(F.lit, nodes))).alias("node"))


def markov_blanket(spark, sf_dir):
    """Of every customer."""
    who = _t(spark, sf_dir, "customer").select(F.lit("sales").alias("net"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return structure.markov_blanket(sales(spark, sf_dir), who).select("node", "member")


def relevant_ancestors(spark, sf_dir):
    return structure.relevant(sales(spark, sf_dir), _some(spark, "n3", "c1"), _known(spark, sf_dir)).select("node")


def d_connected(spark, sf_dir):
    """What the region 0 and the segment BUILDING depend on, given customers in debt and orders in progress."""
    return structure.d_connected(sales(spark, sf_dir), _some(spark, "r0", "sBUILDING"), _known(spark, sf_dir)).select("node")


def topological_levels(spark, sf_dir):
    return structure.topological_levels(sales(spark, sf_dir)).select("node", "level")


def edge_rates(spark, sf_dir):
    a = _alignment(spark, sf_dir).withColumn("graph", F.lit("all"))
    n = a.groupBy("graph", "leaf").agg(F.count("sym").alias("n"))
    j = reconstruction.jumps(a, HOURS).withColumn("graph", F.lit("all"))
    return graphs.edge_rates(j, n).select("from_pos", "to_pos", F.round("rate", 9).alias("rate"))


def tree_leaf_paths(spark, sf_dir):
    return trees.leaf_paths(world(spark, sf_dir)).select("node", "anc", F.round("dist", 6).alias("dist"))


def length_fits(spark, sf_dir):
    """Numbers of customers' orders by status."""
    n = _t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("k"))
    f = lengths.length_fits(n, "k", ["o_orderstatus"])
    return f.select("o_orderstatus", "n", "top", *(F.round(c, 5 if not c.endswith("_ll") else 3).alias(c) for c in f.columns[3:]))


def fisher_exact(spark, sf_dir):
    """Returned against large lines, by line number."""
    f = lengths.fisher_exact(_t(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity") > 25, ["l_linenumber"])
    return f.select("l_linenumber", "n11", "n12", "n21", "n22", *(F.round(c, 6).alias(c) for c in ("p", "less", "greater", "both")))


def latin_hypercube(spark, sf_dir):
    """Whether each stratum of each dimension has one of the parts."""
    p = _t(spark, sf_dir, "part")
    u = lengths.latin_hypercube(p, "p_partkey", 2, 7).crossJoin(F.broadcast(p.agg(F.countDistinct("p_partkey").alias("t"))))  # one row
    return u.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.floor(F.col(f"u{d}") * F.col("t")).alias("stratum")) for d in (1, 2)))).alias("x")).groupBy("x.dimension", "x.stratum").agg(F.count(F.lit(1)).alias("n"))


_R = "p_retailprice / 1000"


def expression_functions(spark, sf_dir):
    """Distributions, bases and schedules of parts' prices and sizes."""
    r, t, k = F.col("p_retailprice") / 1000, F.col("p_size").cast("double"), F.col("p_size")
    made = {
        "wd": X.weibull_density(r, 1.5, 2.0), "wc": X.weibull_cdf(r, 1.5, 2.0), "wq": X.weibull_quantile(t / 100, 1.5, 2.0), "lc": X.log_choose(F.lit(60), k),
        "nm": X.negative_binomial_mass(k, 3.5, 0.2), "rg": X.gaussian_basis(r, 2.0), "rm": X.multiquadric_basis(r, 2.0), "ri": X.inverse_multiquadric_basis(r, 2.0), "rt": X.thin_plate_basis(r, 2.0),
        "sw": X.piecewise(t, [10, 30], [1.0, 0.5, 0.1]), "sp": X.polynomial_decay(t, 1.0, 20, 0.1, 2), "sc": X.polynomial_decay(t, 1.0, 20, 0.1, 2, cycle=True),
        "si": X.inverse_decay(t, 1.0, 7, 0.5, staircase=True), "se": X.exponential_decay(t, 1.0, 7, 0.5), "so": X.cosine_decay(t, 1.0, 20, 0.1),
    }
    return _t(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in made.items()))


def complex_functions(spark, sf_dir):
    """Quotient, exponential and tangent of a complex number made of each part's price and size."""
    z, w = X.complex_number(F.col("p_retailprice") / 1000, F.col("p_size") / 50), X.complex_number(F.lit(1), F.lit(2))
    q, e, t = X.c_divide(X.c_multiply(z, z), X.c_add(z, w)), X.c_exp(z), X.c_tan(z)
    parts = {"q_re": q["re"], "q_im": q["im"], "e_re": e["re"], "e_im": e["im"], "t_re": t["re"], "t_im": t["im"], "modulus": X.c_modulus(z), "phase": X.c_phase(z)}
    return _t(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in parts.items()))


QUERIES = {f.__name__: f for f in (markov_blanket, relevant_ancestors, d_connected, topological_levels, edge_rates, tree_leaf_paths, length_fits, fisher_exact, latin_hypercube, expression_functions, complex_functions)}

_ANC = "SELECT e.parent FROM {from_} x JOIN edges e ON e.child = x.node"
_HALVE = "SELECT {g}, n, top, {m}, CASE WHEN {e} < {m} THEN ({lo} + {hi}) / 2 ELSE {lo} END, CASE WHEN {e} < {m} THEN {hi} ELSE ({lo} + {hi}) / 2 END, i + 1 FROM {t} WHERE i < 60"
_W = "list_sum(list_transform(range(1, top + 1), lambda k: {v} * exp((lo + hi) / 2 * {v})))"
_Z = "list_sum(list_transform(range(1, top + 1), lambda k: exp((lo + hi) / 2 * {v})))"


def _halving(table: str, mean: str, log_ratio: str) -> str:
    """Exponents by halving: the mean of the log ratio rises with the exponent."""
    e = f"({_W.format(v=log_ratio)} / {_Z.format(v=log_ratio)})"
    return f"{table}(g, n, top, m, lo, hi, i) AS (SELECT g, n, top, {mean}, -64::DOUBLE, 64::DOUBLE, 0 FROM s UNION ALL {_HALVE.format(g='g', m='m', e=e, lo='lo', hi='hi', t=table)})"


ORACLE_SQL = {
    "markov_blanket": f"""WITH {_SALES} SELECT parent AS node, child AS member FROM edges WHERE parent LIKE 'c%' UNION SELECT child, parent FROM edges WHERE child LIKE 'c%'
UNION SELECT a.parent, b.parent FROM edges a JOIN edges b ON a.child = b.child AND a.parent <> b.parent WHERE a.parent LIKE 'c%'""",
    "relevant_ancestors": f"""WITH RECURSIVE {_SALES}, {_KNOWN}, q AS (SELECT unnest(['n3', 'c1']) AS node), first AS (SELECT node FROM q WHERE node NOT IN (SELECT node FROM known) UNION SELECT node FROM known),
anc(node) AS ({_ANC.format(from_='first')} UNION {_ANC.format(from_='anc')}) SELECT DISTINCT node FROM anc""",
    "d_connected": f"""WITH RECURSIVE {_SALES}, {_KNOWN}, anc(node) AS (SELECT node FROM known UNION {_ANC.format(from_='anc')}),
moves AS (SELECT child AS node, true AS up, parent AS to_node, true AS to_up FROM edges WHERE child NOT IN (SELECT node FROM known) UNION SELECT parent, true, child, false FROM edges WHERE parent NOT IN (SELECT node FROM known)
UNION SELECT parent, false, child, false FROM edges WHERE parent NOT IN (SELECT node FROM known) UNION SELECT child, false, parent, true FROM edges WHERE child IN (SELECT node FROM anc)),
ball(node, up) AS (SELECT unnest(['r0', 'sBUILDING']), true UNION SELECT m.to_node, m.to_up FROM ball b JOIN moves m ON m.node = b.node AND m.up = b.up) SELECT DISTINCT node FROM ball""",
    "topological_levels": f"""WITH RECURSIVE {_SALES}, walk(node, level) AS (SELECT DISTINCT parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION SELECT e.child, level + 1 FROM walk w JOIN edges e ON e.parent = w.node)
SELECT node, max(level)::INT AS level FROM walk GROUP BY node""",
    "edge_rates": f"""WITH {_ALIGNMENT}, th AS (SELECT leaf, pos FROM al WHERE sym IS NOT NULL), n AS (SELECT leaf, count(sym) AS n FROM al GROUP BY leaf),
j AS (SELECT leaf, pos AS from_pos, coalesce(lead(pos) OVER (PARTITION BY leaf ORDER BY pos), {HOURS}) AS to_pos FROM th UNION ALL SELECT leaf, -1, min(pos) FROM th GROUP BY leaf),
e AS (SELECT from_pos, to_pos, sum(n) AS s FROM j JOIN n USING (leaf) GROUP BY ALL)
SELECT from_pos, to_pos, round((1 + s) / (count(*) OVER (PARTITION BY from_pos) + (SELECT sum(n) FROM n)), 9) AS rate FROM e""",
    "tree_leaf_paths": f"{_UP} SELECT up.node, up.anc, round(w.dist, 6) AS dist FROM up JOIN world w ON w.node = up.anc WHERE up.node NOT IN (SELECT parent FROM world WHERE parent IS NOT NULL)",
    "length_fits": f"""WITH RECURSIVE c AS (SELECT o_orderstatus AS g, count(*) AS k, max(count(*)) OVER (PARTITION BY o_orderstatus) AS top FROM orders GROUP BY o_custkey, o_orderstatus),
s AS (SELECT g, count(*) AS n, max(top) AS top, sum(k)::DOUBLE AS sx, sum(ln(k)) AS sl, sum(ln((top + 1 - k) / k)) AS sr, sum(lgamma(k + 1)) AS sf FROM c GROUP BY g),
{_halving('zi', '-sl / n', '(-ln(k))')}, {_halving('la', 'sr / n', 'ln((top + 1 - k) / k)')},
po(g, m, lo, hi, i) AS (SELECT g, sx / n, 0::DOUBLE, sx / n, 0 FROM s UNION ALL SELECT g, m, CASE WHEN x < m THEN (lo + hi) / 2 ELSE lo END, CASE WHEN x < m THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, (lo + hi) / 2 / (1 - exp(-(lo + hi) / 2)) AS x FROM po WHERE i < 60)),
z AS (SELECT g, (lo + hi) / 2 AS e, ln({_Z.format(v='(-ln(k))')}) AS lz FROM zi WHERE i = 60), l AS (SELECT g, (lo + hi) / 2 AS e, ln({_Z.format(v='ln((top + 1 - k) / k)')}) AS lz FROM la WHERE i = 60), p AS (SELECT g, hi AS e FROM po WHERE i = 60)
SELECT s.g AS o_orderstatus, n, top, round(p.e, 5) AS rate, round(sx * ln(p.e) - n * p.e - sf - n * ln(1 - exp(-p.e)), 3) AS rate_ll, round(CASE WHEN -sl / n > -ln(top) AND sl > 0 THEN z.e END, 5) AS zipf, round(CASE WHEN -sl / n > -ln(top) AND sl > 0 THEN -z.e * sl - n * z.lz END, 3) AS zipf_ll,
round(CASE WHEN abs(sr / n) < ln(top) THEN l.e END, 5) AS lavalette, round(CASE WHEN abs(sr / n) < ln(top) THEN l.e * sr - n * l.lz END, 3) AS lavalette_ll FROM s JOIN z USING (g) JOIN l USING (g) JOIN p USING (g)""",
    "fisher_exact": """WITH t AS (SELECT l_linenumber, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n12, count(*) FILTER (NOT a AND b) AS n21, count(*) FILTER (NOT a AND NOT b) AS n22 FROM (SELECT l_linenumber, l_returnflag = 'R' AS a, l_quantity > 25 AS b FROM lineitem) GROUP BY ALL),
m AS (SELECT *, n11 + n12 AS r, n11 + n21 AS c, n11 + n12 + n21 + n22 AS n FROM t), v AS (SELECT *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) AS x FROM m),
q AS (SELECT *, exp(lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(c - x + 1) - lgamma(n - r - c + x + 1) - lgamma(n + 1) + lgamma(c + 1) + lgamma(n - c + 1)) AS w FROM v), o AS (SELECT *, max(w) FILTER (x = n11) OVER (PARTITION BY l_linenumber) AS p0 FROM q)
SELECT l_linenumber, n11, n12, n21, n22, round(max(p0), 6) AS p, round(sum(w) FILTER (x <= n11), 6) AS less, round(sum(w) FILTER (x >= n11), 6) AS greater, round(sum(w) FILTER (w <= p0 * (1 + 1e-8)), 6) AS both FROM o GROUP BY ALL""",
    "latin_hypercube": "SELECT d::INT AS dimension, unnest(range(0, t)) AS stratum, 1::BIGINT AS n FROM (SELECT count(DISTINCT p_partkey) AS t FROM part), (SELECT unnest([1, 2]) AS d)",
    "expression_functions": f"""WITH x AS (SELECT p_partkey, {_R} AS r, p_size::DOUBLE AS t, p_size AS k FROM part)
SELECT p_partkey, round(1.5 / 2 * (r / 2) ** 0.5 * exp(-((r / 2) ** 1.5)), 6) AS wd, round(1 - exp(-((r / 2) ** 1.5)), 6) AS wc, round(2 * (-ln(1 - t / 100)) ** (1 / 1.5), 6) AS wq, round(lgamma(61) - lgamma(k + 1) - lgamma(61 - k), 6) AS lc,
round(exp(lgamma(k + 3.5) - lgamma(k + 1) - lgamma(3.5) + 3.5 * ln(0.2) + k * ln(0.8)), 6) AS nm, round(exp(-0.5 * r * r / 4), 6) AS rg, round(sqrt(r * r + 4), 6) AS rm, round(1 / sqrt(r * r + 4), 6) AS ri, round(r * r * ln(r / 2), 6) AS rt,
CASE WHEN t <= 10 THEN 1 WHEN t <= 30 THEN 0.5 ELSE 0.1 END::DOUBLE AS sw, round(0.9 * (1 - least(t, 20) / 20) ** 2 + 0.1, 6) AS sp, round(0.9 * (1 - t / (20 * greatest(1, ceil(t / 20)))) ** 2 + 0.1, 6) AS sc,
round(1 / (1 + 0.5 * floor(t / 7)), 6) AS si, round(0.5 ** (t / 7), 6) AS se, round(0.1 + 0.9 * (1 + cos(pi() * least(t, 20) / 20)) / 2, 6) AS so FROM x""",
    "complex_functions": f"""WITH z AS (SELECT p_partkey, {_R} AS a, p_size / 50 AS b FROM part), y AS (SELECT *, a * a - b * b AS sa, 2 * a * b AS sb, a + 1 AS c, b + 2 AS d, cos(2 * a) + cosh(2 * b) AS tn FROM z)
SELECT p_partkey, round((sa * c + sb * d) / (c * c + d * d), 6) AS q_re, round((sb * c - sa * d) / (c * c + d * d), 6) AS q_im, round(exp(a) * cos(b), 6) AS e_re, round(exp(a) * sin(b), 6) AS e_im,
round(sin(2 * a) / tn, 6) AS t_re, round(sinh(2 * b) / tn, 6) AS t_im, round(sqrt(a * a + b * b), 6) AS modulus, round(atan2(b, a), 6) AS phase FROM y""",
}
