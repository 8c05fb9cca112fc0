"""Queries of substitution models, likelihood of presence and its events, tails of distributions, text codes, tree texts and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import sequences as S
from cladeframe.functions import special
from cladeframe.functions import vectors as V
from cladeframe.operators import graphs, reconstruction, trees
from cladeframe.plans import models, tree_sql
from cladeframe.plans.graph_queries import _ALIGNMENT, _GAPS, _JUMPS, HOURS, _alignment
from cladeframe.plans.tree import newick, parse
from cladeframe.plans.tree_queries import _UP, _WORLD, _user_tree, world

NAMES = ("JC", "Yang", "SIMPLE_3", "Gap", "GLOOME1")
MU, LAM = 0.1, 0.15


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_transitions(spark, sf_dir):
    """P(t) of each model by name, and of one with a gap, at times made of parts' sizes; t null: stationary frequencies."""
    times = sorted(r[0] / 40 for r in _t(spark, sf_dir, "part").select("p_size").distinct().collect())  # at most 50 sizes
    made = {**{n: models.by_name(n) for n in NAMES}, "Yang with gap": models.with_gap(models.yang(), MU, LAM)}
    rows = [m.rows(spark, times).select(F.lit(n).alias("model"), "t", "x", "y", F.round("p", 6).alias("p")) for n, m in made.items()]
    still = spark.createDataFrame([(n, None, "", y, round(float(f), 6)) for n, m in made.items() for y, f in zip(m.alphabet, m.freqs)], "model string, t double, x string, y string, p double")
    return reduce(DataFrame.unionByName, [*rows, still])


def presence_likelihood(spark, sf_dir):
    """Whether ancestors have each hour, jointly most probable."""
    return reconstruction.presence_by_likelihood(_alignment(spark, sf_dir), _user_tree()).withColumn("log_likelihood", F.round("log_likelihood", 6))


def _presence(spark, sf_dir):
    inner = reconstruction.presence_by_likelihood(_alignment(spark, sf_dir), _user_tree()).select("node", F.col("site").alias("pos"), F.col("state").cast("int").alias("p"))
    own = _alignment(spark, sf_dir).select(F.col("leaf").alias("node"), "pos", F.col("sym").isNotNull().cast("int").alias("p"))
    tree = spark.createDataFrame([(lab, _user_tree().labels[p]) for lab, p in zip(_user_tree().labels, _user_tree().parents) if p >= 0], "node string, parent string")
    return inner.unionByName(own), tree


def branch_events(spark, sf_dir):
    """Insertions and deletions, as runs of hours, on each branch."""
    return reconstruction.indel_events(*_presence(spark, sf_dir))


def indel_lengths(spark, sf_dir):
    return reconstruction.indel_lengths(*_presence(spark, sf_dir))


def indel_coding_likelihood(spark, sf_dir):
    """Gaps of the users' alignment as characters, jointly most probable at the ancestors."""
    return reconstruction.indel_coding_likelihood(_alignment(spark, sf_dir), _user_tree(), HOURS).withColumn("log_likelihood", F.round("log_likelihood", 6))


def long_jumps(spark, sf_dir):
    """Jumps of groups of users over at least one hour."""
    e = reconstruction.jumps(_alignment(spark, sf_dir), HOURS).select(F.col("leaf").alias("graph"), "from_pos", "to_pos")
    return graphs.jumps(e)


def tail_probabilities(spark, sf_dir):
    """Of parts' sizes: tails of the binomial, chi-square, F and t distributions and the normal distribution function."""
    k = F.col("p_size").cast("double")
    made = {
        "binomial": special.binomial_tail(k, F.lit(60.0), F.lit(0.4)), "chi_square": special.chi_square_tail(k, F.lit(8.0)), "f": special.f_tail(k / 10, F.lit(2.0), F.lit(9.0)),
        "student": special.student_two_tailed(k / 10, F.lit(2.0)), "normal": special.normal_cdf(k / 25, F.lit(1.0), F.lit(0.8)), "poisson": special.poisson_cdf(F.lit(4.0), k / 8), "lfactorial": special.lgamma_col(k + 1),
    }
    return _t(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in made.items()))


def text_codes(spark, sf_dir):
    """Codes of parts' names and brands: letters' places in an alphabet, deflines, bins, half-up rounding, counted values."""
    letter = F.upper(F.substring("p_name", 1, 1))
    counted = F.concat(F.col("p_size").cast("string"), F.lit("_count=2;"), (F.col("p_size") + 1).cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit("_count=1"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", S.symbol_index(letter, S.PROTEIN).cast("int").alias("place"), S.is_valid(letter, S.PROTEIN).alias("valid"), S.defline(F.col("p_brand")).alias("defline"),
        S.width_thresholds(F.col("p_size"), [10, 20, 35]).cast("int").alias("bin"), V.round_half_up(F.col("p_retailprice") / 7 - 200, 1).alias("rounded"), S.counted_values(counted).alias("counted"),
        V.inside_polygon(F.col("p_size").cast("double"), F.col("p_retailprice") / 40, [(5.0, 5.0), (45.0, 10.0), (40.0, 40.0), (20.0, 20.0), (8.0, 48.0)]).alias("inside"),
    ).withColumn("counted", F.concat_ws(",", F.transform("counted", lambda v: v.cast("string"))))


def _places(spark, sf_dir):
    """Nations within regions as a Newick text; branches as long as the names."""
    r = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.concat(F.lit("'"), "n_name", F.lit("':"), F.length("n_name").cast("string"))
    groups = r.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list(leaf)), ",").alias("g")).select(F.concat(F.lit("("), "g", F.lit(")'"), "r_name", F.lit("':"), F.length("r_name").cast("string")).alias("g"))
    return groups.agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("g")), ","), F.lit(")world;")).alias("text")).first()[0]  # a few dozen names


def newick_round_trip(spark, sf_dir):
    """The tree of places read from its text, written and read again."""
    first = parse(_places(spark, sf_dir))
    text = newick(first)
    again = parse(text.replace(" ", "_"))
    return again.rows(spark).select("label", F.col("dist"), F.col("parent").isNull().alias("root"))


def tree_checks(spark, sf_dir):
    """Where the tree of places and the suppliers' and customers' names don't agree."""
    w = world(spark, sf_dir)
    names = _t(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name")).unionByName(_t(spark, sf_dir, "supplier").where("s_suppkey <= 3").select(F.col("s_name").alias("name")))
    twice = names.unionByName(names.where("name LIKE '%7'"))
    return trees.integrity_issues(w, twice)


def tree_rescaled(spark, sf_dir):
    """Branches of places so that customers are ten from the root on average."""
    return trees.rescaled(world(spark, sf_dir), 10.0).select("node", F.round("dist", 6).alias("dist"))


def tree_from_paths(spark, sf_dir):
    """Branches set again from the matrix of customers' ways, all of them doubled."""
    w = world(spark, sf_dir)
    paths = trees.leaf_paths(w).withColumn("dist", F.col("dist") * 2)
    return trees.with_leaf_paths(w, paths).select("node", F.round("dist", 6).alias("dist"))


QUERIES = {f.__name__: f for f in (model_transitions, presence_likelihood, branch_events, indel_lengths, indel_coding_likelihood, long_jumps, tail_probabilities, text_codes, newick_round_trip, tree_checks, tree_rescaled, tree_from_paths)}


def _rates(name: str, letters: str | tuple, freqs: list, rates: list) -> str:
    return ", ".join(f"('{name}', '{x}', '{y}', {freqs[i]}::DOUBLE, {freqs[j]}::DOUBLE, {rates[i][j]}::DOUBLE)" for i, x in enumerate(letters) for j, y in enumerate(letters) if i != j)


# The models' published rates, in the order of their letters.
_RAW = ", ".join((
    _rates("Yang", "ACGT", [0.308, 0.185, 0.199, 0.308], [[0, 0.139, 0.566, 0.115], [0.232, 0, 0.223, 0.882], [0.877, 0.207, 0, 0.215], [0.115, 0.530, 0.139, 0]]),
    _rates("SIMPLE_3", "VAN", [0.3333] * 3, [[0, 0.2, 0.4], [0.2, 0, 0.6], [0.2, 0.4, 0]]),
    _rates("Gap", "GC", [0.1, 0.9], [[0, 0.54], [0.54, 0]]),
    _rates("GLOOME1", ("true", "false"), [0.5, 0.5], [[0, 0.54], [6.61, 0]]),
))
_TRANSITIONS = f"""WITH RECURSIVE raw(model, x, y, fx, fy, r) AS (VALUES {_RAW}),
scale AS (SELECT model, sum(fx * r) AS s FROM raw GROUP BY model), off AS (
  SELECT model, x, y, fx, fy, r / s AS r FROM raw JOIN scale USING (model) UNION ALL SELECT 'JC', a, b, 0.25, 0.25, 0.25 FROM (VALUES ('A'), ('C'), ('G'), ('T')) m(a), (VALUES ('A'), ('C'), ('G'), ('T')) n(b) WHERE a <> b),
gapped AS (SELECT * FROM off UNION ALL SELECT 'Yang with gap', x, y, fx * {LAM / (MU + LAM)}, fy * {LAM / (MU + LAM)}, r FROM off WHERE model = 'Yang'
  UNION ALL SELECT DISTINCT 'Yang with gap', x, '-', fx * {LAM / (MU + LAM)}, {MU / (MU + LAM)}, {MU} FROM off WHERE model = 'Yang' UNION ALL SELECT DISTINCT 'Yang with gap', '-', y, {MU / (MU + LAM)}, fy * {LAM / (MU + LAM)}, {LAM} * fy FROM off WHERE model = 'Yang'),
q AS MATERIALIZED (SELECT model, x, y, r FROM gapped UNION ALL SELECT model, x, x, -sum(r) FROM gapped GROUP BY model, x),
times AS (SELECT DISTINCT p_size / 40 AS t FROM part),
term(k, model, t, x, y, v) AS (SELECT 0, model, t, x, y, CASE WHEN x = y THEN 1::DOUBLE ELSE 0 END FROM q, times
  UNION ALL SELECT k + 1, term.model, t, term.x, q.y, sum(v * r) * t / (k + 1) FROM term JOIN q ON q.model = term.model AND q.x = term.y WHERE k < 80 GROUP BY k, term.model, t, term.x, q.y)
SELECT model, t, x, y, round(sum(v), 6) AS p FROM term GROUP BY model, t, x, y UNION ALL SELECT DISTINCT model, NULL, '', x, round(fx, 6) FROM gapped"""
_SEEN = tree_sql.joint("SELECT pos AS site, leaf AS node, CASE WHEN sym IS NULL THEN 'b' ELSE 'a' END AS s FROM al", "SELECT unnest(['a', 'b']) AS s", 0.3)
_PRESENCE = f"{_ALIGNMENT}, {_SEEN}, pr AS (SELECT node, site AS pos, (s = 'a')::INT AS p FROM best UNION ALL SELECT leaf, pos, (sym IS NOT NULL)::INT FROM al), df AS (SELECT a.node, a.pos, a.p - b.p AS d FROM pr a JOIN tr ON tr.node = a.node JOIN pr b ON b.node = tr.parent AND b.pos = a.pos), lg AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY node ORDER BY pos), 0) AS was FROM df)"
_POLYGON = [(5.0, 5.0), (45.0, 10.0), (40.0, 40.0), (20.0, 20.0), (8.0, 48.0)]
_INSIDE = " + ".join(f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1]))

ORACLE_SQL = {
    "model_transitions": _TRANSITIONS,
    "presence_likelihood": f"WITH {_ALIGNMENT}, {_SEEN} SELECT best.site, node, CASE s WHEN 'a' THEN '1' ELSE '0' END AS state, round(lp, 6) AS log_likelihood FROM best JOIN top ON top.site = best.site",
    "branch_events": f"WITH {_PRESENCE} SELECT node, count(*) FILTER (d <> 0 AND d <> was) AS events FROM lg GROUP BY node",
    "indel_lengths": f"WITH {_PRESENCE}, rn AS (SELECT node, pos, d, sum(CASE WHEN d <> was THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY pos) AS run FROM lg), le AS (SELECT node, run, d, count(*) AS length FROM rn WHERE d <> 0 GROUP BY ALL) SELECT CASE WHEN d > 0 THEN 'insertion' ELSE 'deletion' END AS kind, length, count(*) AS n FROM le GROUP BY ALL",
    "indel_coding_likelihood": f"""WITH {_GAPS}, {tree_sql.joint("SELECT site, node, '1' AS s FROM inside WHERE same UNION ALL SELECT x.site, 'g' || i, '0' FROM (SELECT DISTINCT site FROM inside) x CROSS JOIN range(8) t(i) ANTI JOIN inside y ON y.site = x.site AND y.node = 'g' || i", "SELECT unnest(['0', '1']) AS s", 0.3)}
SELECT (best.site // {HOURS + 1})::BIGINT AS lo, best.site % {HOURS + 1} AS hi, node, s AS state, round(lp, 6) AS log_likelihood FROM best JOIN top ON top.site = best.site""",
    "long_jumps": f"WITH {_JUMPS} SELECT leaf AS graph, from_pos, to_pos FROM j WHERE to_pos - from_pos > 1",
    "tail_probabilities": """WITH x AS (SELECT p_partkey, p_size::DOUBLE AS k FROM part), z AS (SELECT DISTINCT k, (k / 25 - 1) / 0.8 / sqrt(2) AS z FROM x),
b AS (SELECT z.k, sum(exp(lgamma(61) - lgamma(i + 1) - lgamma(61 - i) + i * ln(0.4) + (60 - i) * ln(0.6))) AS binomial FROM z, range(61) t(i) WHERE i >= z.k GROUP BY z.k),
e AS (SELECT k, 0.5 + sum((CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * pow(z, 2 * i + 1) / exp(lgamma(i + 1)) / (2 * i + 1)) / sqrt(pi()) AS normal FROM z, range(60) t(i) GROUP BY k)
SELECT p_partkey, round(binomial, 6) AS binomial, round(exp(-k / 2) * (1 + k / 2 + pow(k / 2, 2) / 2 + pow(k / 2, 3) / 6), 6) AS chi_square, round(pow(1 + 2 * (k / 10) / 9, -4.5), 6) AS f, round(1 - (k / 10) / sqrt(2 + pow(k / 10, 2)), 6) AS student,
round(normal, 6) AS normal, round(exp(-k / 8) * (1 + k / 8 + pow(k / 8, 2) / 2 + pow(k / 8, 3) / 6 + pow(k / 8, 4) / 24), 6) AS poisson, round(lgamma(k + 1), 6) AS lfactorial FROM x JOIN b USING (k) JOIN e USING (k)""",
    "text_codes": f"""WITH p AS (SELECT *, upper(p_name[1]) AS l, p_size::DOUBLE AS x, p_retailprice / 40 AS y FROM part)
SELECT p_partkey, nullif(position(l IN '{S.PROTEIN}'), 0)::INT - 1 AS place, position(l IN '{S.PROTEIN}') > 0 AS valid, '>' || p_brand AS defline, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 35 THEN 2 ELSE 3 END::INT AS bin,
floor((p_retailprice / 7 - 200) * 10 + 0.5) / 10 AS rounded, p_size || '.0,' || (p_size + 2) || '.0' AS counted, ({_INSIDE}) % 2 = 1 AS inside FROM p""",
    "newick_round_trip": "SELECT replace(n_name, ' ', '_') AS label, length(n_name)::DOUBLE AS dist, false AS root FROM nation UNION ALL SELECT replace(r_name, ' ', '_'), length(r_name), false FROM region UNION ALL SELECT 'world', 0, true",
    "tree_checks": f"""WITH {_WORLD}, lv AS (SELECT label AS name FROM world WHERE node NOT IN (SELECT parent FROM world WHERE parent IS NOT NULL)), n0 AS (SELECT c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT s_name FROM supplier WHERE s_suppkey <= 3), nm AS (SELECT * FROM n0 UNION ALL SELECT * FROM n0 WHERE name LIKE '%7')
SELECT 'duplicate in tree' AS issue, name FROM lv GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'duplicate in alignment', name FROM nm GROUP BY name HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'missing in tree', name FROM nm WHERE name NOT IN (SELECT name FROM lv) UNION ALL SELECT DISTINCT 'missing in alignment', name FROM lv WHERE name NOT IN (SELECT name FROM nm)""",
    "tree_rescaled": f"{_UP}, m AS (SELECT avg(d) AS m FROM (SELECT node, max(d) AS d FROM up WHERE node NOT IN (SELECT parent FROM world WHERE parent IS NOT NULL) GROUP BY node)) SELECT node, round(dist * 10 / m, 6) AS dist FROM world, m",
    "tree_from_paths": f"{_UP} SELECT w.node, round(dist * CASE WHEN w.node IN (SELECT anc FROM up WHERE node NOT IN (SELECT parent FROM world WHERE parent IS NOT NULL)) THEN 2 ELSE 1 END, 6) AS dist FROM world w",
}
