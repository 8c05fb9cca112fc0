"""Queries of gapped columns, cheapest paths, edge sets, factor selections, plain distributions, and files written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import distributions as D
from cladeframe.functions import vectors as V
from cladeframe.operators import factors, graphs, intervals, peeling, reconstruction
from cladeframe.plans import models
from cladeframe.plans.graph_queries import _ALIGNMENT, _JUMPS, HOURS, _alignment
from cladeframe.plans.session import checkpointed
from cladeframe.plans.tree_queries import _user_tree
from cladeframe.plans.tree_sql import _EDGES
from cladeframe.sources import alignments

MU, LAM, STAY, TIME = 0.2, 0.3, 0.9, 0.3


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _event_model(spark, sf_dir):
    return models.jc(tuple(sorted(r[0] for r in _t(spark, sf_dir, "events").select("event_type").distinct().collect())))  # a handful


def gapped_columns(spark, sf_dir):
    """ln of the chance of each hour of the users' groups, with insertions and deletions."""
    sites = _alignment(spark, sf_dir).select(F.col("pos").alias("site"), "leaf", F.col("sym").alias("state"))
    return _rounded(peeling.column_likelihood(sites, _user_tree(), _event_model(spark, sf_dir), MU, LAM, STAY), "lp")


def gap_chances(spark, sf_dir):
    """Of deletion and insertion over times made of parts' sizes."""
    t = F.col("p_size") / 10
    made = {"deletion": peeling.deletion(t, MU, LAM), "insertion": peeling.insertion(t, MU, LAM), "gap": peeling.gap_given_character(t, MU, LAM), "none": peeling.deletion(t, 0, 0)}
    return _t(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 9).alias(n) for n, c in made.items()))


def _weighted(spark, sf_dir):
    """Jumps of each half of the users' groups; one costs the share of the half that doesn't have it, plus a hundredth."""
    j = reconstruction.jumps(_alignment(spark, sf_dir), HOURS).withColumn("graph", F.when(F.col("leaf") < "g4", "left").otherwise("right"))
    return j.groupBy("graph", "from_pos", "to_pos").agg((1.01 - F.count(F.lit(1)) / 4).alias("weight"), F.lit(True).alias("recip"))


def optimal_edges(spark, sf_dir):
    """The edges of all cheapest paths through each half's jumps."""
    return _rounded(graphs.optimal_edges(_weighted(spark, sf_dir), HOURS), "cost")


def graph_depths(spark, sf_dir):
    return graphs.depths(_weighted(spark, sf_dir), HOURS)


def _side(spark, sf_dir, leaf: str) -> DataFrame:
    return reconstruction.jumps(_alignment(spark, sf_dir), HOURS).where(F.col("leaf") == leaf).select(F.lit("x").alias("graph"), "from_pos", "to_pos", F.lit(1).alias("n"))


def graph_union(spark, sf_dir):
    return graphs.union(_side(spark, sf_dir, "g0"), _side(spark, sf_dir, "g1"))


def graph_intersection(spark, sf_dir):
    return graphs.intersection(_side(spark, sf_dir, "g0"), _side(spark, sf_dir, "g1"))


def graph_complement(spark, sf_dir):
    return graphs.complement(_side(spark, sf_dir, "g0"), _side(spark, sf_dir, "g1"))


def graph_precluded(spark, sf_dir):
    """Jumps of the second group that those of the first rule out."""
    return graphs.precluded(_side(spark, sf_dir, "g1"), _side(spark, sf_dir, "g0")).select("from_pos", "to_pos")


def graph_nibbled(spark, sf_dir):
    """What is left of jumps between positions of like parity, or from the start, once dead ends are gone."""
    j = _weighted(spark, sf_dir).where("from_pos = -1 or (to_pos - from_pos) % 2 = 0 or (from_pos + to_pos) % 3 = 0").select("graph", "from_pos", "to_pos")
    return graphs.nibbled(j, HOURS)


def graph_documents(spark, sf_dir):
    """Edges in a JSON document and as lines, by graph: their numbers."""
    e = _weighted(spark, sf_dir).select("graph", "from_pos", "to_pos")
    back = graphs.json_text(e).select("graph", F.explode(F.from_json("value", "Edgeindices array<array<long>>")["Edgeindices"]).alias("x"))
    lines = graphs.dot_text(e).select("graph", F.regexp_extract("value", r"^(-?\d+) -> ", 1).cast("long").alias("from_pos"), F.regexp_extract("value", r" -> (\d+);$", 1).cast("long").alias("to_pos"))
    return back.select("graph", F.col("x")[0].alias("from_pos"), F.col("x")[1].alias("to_pos")).join(lines, ["graph", "from_pos", "to_pos"])


def _counts(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return factors.from_counts(d, ["l_returnflag", "l_linestatus", "l_linenumber"])


def factor_selection(spark, sf_dir):
    """Rows that a partial key matches."""
    return _rounded(factors.matches(_counts(spark, sf_dir), {"l_returnflag": "R", "l_linestatus": None}), "lp")


def factor_total(spark, sf_dir):
    f = factors.log_total(factors.evidence(_counts(spark, sf_dir), {"l_linenumber": 1}))
    return f.select(F.round(f.columns[0], 6).alias("lp"))


def factor_decomposed(spark, sf_dir):
    """All marginals of two variables, in one table."""
    rows = [_rounded(m, "lp").select(F.lit(",".join(k)).alias("variables"), F.concat_ws(",", *(F.col(c).cast("string") for c in k)).alias("key"), "lp") for k, m in factors.decomposed(_counts(spark, sf_dir), 2).items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def distribution_functions(spark, sf_dir):
    """Of parts' sizes and prices."""
    k, r, u = F.col("p_size"), F.col("p_retailprice") / 1000, F.col("p_size") / 100
    made = {
        "ch": D.choose(F.lit(20), k), "be": D.bernoulli_mass(k - 1, 0.3), "ge": D.geometric_mass(k, 0.2), "gc": D.geometric_cdf(k, 0.2), "sg": D.shifted_geometric_mass(k, 0.2), "hy": D.hypergeometric_mass(k, 60, 30, 25),
        "ld": D.logistic_density(r, 1.0, 0.5), "lc": D.logistic_cdf(r, 1.0, 0.5), "lq": D.logistic_quantile(u, 1.0, 0.5), "bd": D.beta_density(u, 2.5, 3.5), "un": D.uniform_density(r, 1.0, 1.5),
        "td": D.triangular_density(u, 0.05, 0.2, 0.4), "tq": D.triangular_quantile(u, 0.05, 0.2, 0.4), "pl": D.power_law_mass(k, 2.0, 40),
    }
    return _t(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in made.items()), D.is_prime(F.col("p_partkey")).alias("prime"))


def array_functions(spark, sf_dir):
    """Of the quantities of each order's lines."""
    q = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("x"))  # at most seven lines
    scaled = F.transform("x", lambda v: v / 100)
    made = {"total": V.total(F.col("x")), "mode": D.mode(F.col("x")), "second": F.when(F.size("x") > 1, V.kth_smallest(F.col("x"), 1)), "lse": V.log_sum_exp(F.col("x")), "lol": V.log_sum_of_logs(F.col("x")[0], F.col("x")[0] + 1),
            "sig": V.sigmoid(scaled[0]), "soft": V.log1pe(scaled[0]), "unit": V.unit(F.col("x"))[0], "axpy": V.total(V.axpy(F.lit(2.0), F.col("x"), scaled)), "left": V.total(V.omit(F.col("x"), F.col("x")[0]))}
    return q.select("l_orderkey", *(F.round(c, 6).alias(n) for n, c in made.items()))


def interval_points(spark, sf_dir):
    """Centres of the intervals, made of orders' keys, that overlap one from 10 to 40."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 7).alias("hi"))
    meets = intervals.overlaps(F.col("lo"), F.col("hi"), F.lit(10), F.lit(40))
    return o.where(meets).select("o_orderkey", intervals.centre(F.col("lo"), F.col("hi")).cast("double").alias("centre"))


def _folder(spark: SparkSession) -> str:
    checkpointed(spark.range(1))  # sets the shared folder where none is
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"


def _letters(spark, sf_dir):
    """The alignment with the types' first letters, a record a group."""
    seen = F.map_from_entries(F.collect_list(F.struct("pos", F.upper(F.substring("sym", 1, 1)))))  # a day's hours
    a = _alignment(spark, sf_dir).groupBy("leaf").agg(seen.alias("m")).select("leaf", F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: F.try_element_at("m", h.cast("long"))).alias("seq"))
    return a.select(F.col("leaf").alias("name"), F.lit("").alias("info"), F.substring("leaf", 2, 9).cast("int").alias("seq_idx"), "seq")


def fasta_round_trip(spark, sf_dir):
    """The users' alignment written as FASTA, sniffed, read again and put in long form."""
    path = _folder(spark)
    alignments.write_fasta(_letters(spark, sf_dir), path)
    return alignments.long_form(alignments.read_alignment(spark, path)).select("leaf", "pos", "sym")


def clustal_round_trip(spark, sf_dir):
    """The same by Clustal: one file, in blocks of ten."""
    path, lines = _folder(spark), alignments.clustal_text(_letters(spark, sf_dir), block=10)
    head = spark.range(1).select(F.lit(-1).alias("block"), F.lit(-1).alias("seq_idx"), F.lit("CLUSTAL").alias("value"))
    lines.unionByName(head).coalesce(1).sortWithinPartitions("block", "seq_idx").select("value").write.text(path)
    return alignments.long_form(alignments.read_alignment(spark, path)).select("leaf", "pos", "sym")


def table_round_trip(spark, sf_dir):
    """Customers as tab-separated text; negative balances written as nothing and read as null."""
    path = _folder(spark)
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    alignments.write_table(c, path)
    return alignments.read_table(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


QUERIES = {f.__name__: f for f in (gapped_columns, gap_chances, optimal_edges, graph_depths, graph_union, graph_intersection, graph_complement, graph_precluded, graph_nibbled, graph_documents, factor_selection, factor_total, factor_decomposed, distribution_functions, array_functions, interval_points, fasta_round_trip, clustal_round_trip, table_round_trip)}

_HALVES = f"{_JUMPS}, we AS MATERIALIZED (SELECT CASE WHEN leaf < 'g4' THEN 'left' ELSE 'right' END AS graph, from_pos, to_pos, 1.01::DOUBLE - count(*) / 4 AS w FROM j GROUP BY ALL)"
#: Cheapest ways of each number of edges from either end.
_WAYS = f"""{_HALVES}, ahead(graph, pos, n, c) AS (SELECT DISTINCT graph, -1::BIGINT, 0, 0::DOUBLE FROM we UNION ALL SELECT a.graph, we.to_pos, a.n + 1, min(a.c + we.w) FROM ahead a JOIN we ON we.graph = a.graph AND we.from_pos = a.pos GROUP BY ALL),
back(graph, pos, n, c) AS (SELECT DISTINCT graph, {HOURS}::BIGINT, 0, 0::DOUBLE FROM we UNION ALL SELECT a.graph, we.from_pos, a.n + 1, min(a.c + we.w) FROM back a JOIN we ON we.graph = a.graph AND we.to_pos = a.pos GROUP BY ALL),
f AS (SELECT graph, pos, min(n) AS n, min(c) AS c FROM ahead GROUP BY ALL), b AS (SELECT graph, pos, min(n) AS n, min(c) AS c FROM back GROUP BY ALL)"""
_TWO = f"{_JUMPS}, a AS (SELECT from_pos, to_pos FROM j WHERE leaf = 'g0'), b AS (SELECT from_pos, to_pos FROM j WHERE leaf = 'g1')"
_LETTER = f"WITH {_ALIGNMENT} SELECT l.leaf, h.pos, upper(sym[1]) AS sym FROM (SELECT DISTINCT leaf FROM al) l CROSS JOIN range({HOURS}) h(pos) LEFT JOIN al ON al.leaf = l.leaf AND al.pos = h.pos"


def _peeled() -> str:
    """The chances level by level; letters alike but for the one a leaf has, so the model's steps are in closed form."""
    here = f"{LAM / (MU + LAM)}::DOUBLE + {MU / (MU + LAM)}::DOUBLE * exp(-{(MU + LAM) * TIME}::DOUBLE)"
    came, went = f"({LAM / (MU + LAM)}::DOUBLE * (1 - exp(-{(MU + LAM) * TIME}::DOUBLE)))", f"({MU / (MU + LAM)}::DOUBLE * (1 - exp(-{(MU + LAM) * TIME}::DOUBLE)))"
    stays = f"exp(-{MU * TIME}::DOUBLE)"
    out = [
        _ALIGNMENT, _EDGES, "letters AS (SELECT DISTINCT event_type AS s FROM events)", "size AS (SELECT count(*)::DOUBLE AS k FROM letters)",
        f"step AS MATERIALIZED (SELECT a.s AS x, b.s AS y, ({here} - {stays}) / k + {stays} * (CASE WHEN a.s = b.s THEN 1 / k + (1 - 1 / k) * exp(-{TIME}::DOUBLE) ELSE (1 - exp(-{TIME}::DOUBLE)) / k END) AS p FROM letters a, letters b, size)",
        "l0 AS MATERIALIZED (SELECT s.pos, n.node, letters.s, CASE WHEN al.sym = letters.s THEN 1::DOUBLE ELSE 0 END AS r, al.sym IS NULL AS empty, 0::DOUBLE AS g FROM (SELECT DISTINCT pos FROM al) s CROSS JOIN (SELECT 'g' || i AS node FROM range(8) t(i)) n CROSS JOIN letters LEFT JOIN al ON al.pos = s.pos AND al.leaf = n.node)",
    ]
    for k in (1, 2, 3):
        own = f"{came}" if k < 3 else "0::DOUBLE"
        out.append(f"""k{k} AS MATERIALIZED (SELECT pos, node, x AS s, sum(p * r) * (1 - {came}) + CASE WHEN bool_and(empty) THEN {went} * (1 - {came}) ELSE 0 END AS m, bool_and(empty) AS empty,
CASE WHEN bool_and(empty) THEN {own} * {LAM / (MU + LAM)}::DOUBLE * (SELECT sum(r) / max(k) FROM l{k - 1} z, size WHERE z.pos = l.pos AND z.node = l.node) + max(g) ELSE 0 END AS g FROM l{k - 1} l JOIN step ON l.s = y GROUP BY pos, node, x)""")
        out.append(f"l{k} AS MATERIALIZED (SELECT pos, parent AS node, s, product(m) AS r, bool_and(empty) AS empty, sum(g) AS g FROM k{k} JOIN tr USING (node) GROUP BY ALL)")
    return "WITH " + ",\n".join(out) + f" SELECT pos AS site, round(ln(max(g) + {STAY} * {LAM / (MU + LAM)}::DOUBLE * sum(r) / max(k)), 6) AS lp FROM l3, size GROUP BY pos"


_COUNTS = "n AS (SELECT l_returnflag, l_linestatus, l_linenumber::INT AS l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)"
_PAIR = "SELECT '{0},{1}' AS variables, {0} || ',' || {1} AS key, round(ln(sum(c)), 6) AS lp FROM n GROUP BY {0}, {1}"

ORACLE_SQL = {
    "gapped_columns": _peeled(),
    "gap_chances": f"WITH x AS (SELECT p_partkey, 1 - exp(-{MU + LAM} * p_size / 10) AS e FROM part) SELECT p_partkey, round({MU / (MU + LAM)} * e, 9) AS deletion, round({LAM / (MU + LAM)} * e, 9) AS insertion, round((1 - {LAM / (MU + LAM)} * e) * {MU / (MU + LAM)} * e, 9) AS gap, 0::DOUBLE AS none FROM x",
    "optimal_edges": f"WITH RECURSIVE {_WAYS} SELECT we.graph, from_pos, to_pos, round(t.c, 6) AS cost FROM we JOIN f ON f.graph = we.graph AND f.pos = from_pos JOIN b ON b.graph = we.graph AND b.pos = to_pos JOIN f t ON t.graph = we.graph AND t.pos = {HOURS} WHERE f.c + w + b.c <= t.c + 1e-9 * t.c",
    "graph_depths": f"WITH RECURSIVE {_WAYS} SELECT p.graph, p.pos, f.n::BIGINT AS to_start, b.n::BIGINT AS to_end FROM (SELECT graph, from_pos AS pos FROM we UNION SELECT graph, to_pos FROM we) p LEFT JOIN f ON f.graph = p.graph AND f.pos = p.pos LEFT JOIN b ON b.graph = p.graph AND b.pos = p.pos WHERE p.pos BETWEEN 0 AND {HOURS - 1}",
    "graph_union": f"WITH {_TWO} SELECT 'x' AS graph, from_pos, to_pos, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL",
    "graph_intersection": f"WITH {_TWO} SELECT 'x' AS graph, from_pos, to_pos, 1 AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)",
    "graph_complement": f"WITH {_TWO} SELECT 'x' AS graph, from_pos, to_pos, 1 AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "graph_precluded": f"WITH {_TWO} SELECT DISTINCT b.from_pos, b.to_pos FROM b JOIN a ON (b.from_pos > a.from_pos AND b.from_pos < a.to_pos) OR (b.to_pos > a.from_pos AND b.to_pos < a.to_pos)",
    "graph_nibbled": f"""WITH RECURSIVE {_HALVES}, e AS MATERIALIZED (SELECT graph, from_pos, to_pos FROM we WHERE from_pos = -1 OR (to_pos - from_pos) % 2 = 0 OR (from_pos + to_pos) % 3 = 0),
fw(graph, pos) AS (SELECT DISTINCT graph, -1::BIGINT FROM e UNION SELECT e.graph, e.to_pos FROM fw JOIN e ON e.graph = fw.graph AND e.from_pos = fw.pos), bw(graph, pos) AS (SELECT DISTINCT graph, {HOURS}::BIGINT FROM e UNION SELECT e.graph, e.from_pos FROM bw JOIN e ON e.graph = bw.graph AND e.to_pos = bw.pos)
SELECT e.* FROM e JOIN fw ON fw.graph = e.graph AND fw.pos = from_pos JOIN bw ON bw.graph = e.graph AND bw.pos = to_pos""",
    "graph_documents": f"WITH {_HALVES} SELECT graph, from_pos, to_pos FROM we",
    "factor_selection": f"WITH {_COUNTS} SELECT l_returnflag, l_linestatus, l_linenumber, round(ln(c), 6) AS lp FROM n WHERE l_returnflag = 'R'",
    "factor_total": f"WITH {_COUNTS} SELECT round(ln(sum(c)), 6) AS lp FROM n WHERE l_linenumber = 1",
    "factor_decomposed": f"WITH {_COUNTS} {' UNION ALL '.join(_PAIR.format(*p) for p in (('l_returnflag', 'l_linestatus'), ('l_returnflag', 'l_linenumber'), ('l_linestatus', 'l_linenumber')))}",
    "distribution_functions": """WITH x AS (SELECT p_partkey, p_size AS k, p_retailprice / 1000 AS r, p_size / 100 AS u FROM part), z AS (SELECT sum(i ** -2.0) AS z FROM range(1, 41) t(i)), lc AS (SELECT *, lgamma(61) - lgamma(26) - lgamma(36) AS d FROM x, z)
SELECT p_partkey, CASE WHEN k <= 20 THEN round(exp(lgamma(21) - lgamma(k + 1) - lgamma(greatest(21 - k, 1)))) ELSE 0 END AS ch, CASE k WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0 END::DOUBLE AS be, round(0.2 * 0.8 ** k, 6) AS ge, round(1 - 0.8 ** (k + 1), 6) AS gc, round(0.2 * 0.8 ** (k - 1), 6) AS sg,
CASE WHEN k <= 25 THEN round(exp(lgamma(31) - lgamma(k + 1) - lgamma(greatest(31 - k, 1)) + lgamma(31) - lgamma(greatest(26 - k, 1)) - lgamma(6 + k) - d), 6) ELSE 0 END AS hy,
round(exp(-(r - 1) / 0.5) / (0.5 * (1 + exp(-(r - 1) / 0.5)) ** 2), 6) AS ld, round(1 / (1 + exp(-(r - 1) / 0.5)), 6) AS lc, round(1 + 0.5 * ln(u / (1 - u)), 6) AS lq, round(exp(1.5 * ln(u) + 2.5 * ln(1 - u) + lgamma(6) - lgamma(2.5) - lgamma(3.5)), 6) AS bd,
CASE WHEN r BETWEEN 1 AND 1.5 THEN 2 ELSE 0 END::DOUBLE AS un, round(CASE WHEN u < 0.05 OR u > 0.4 THEN 0 WHEN u < 0.2 THEN 2 * (u - 0.05) / (0.35 * 0.15) ELSE 2 * (0.4 - u) / (0.35 * 0.2) END::DOUBLE, 6) AS td,
round(CASE WHEN u < 0.15 / 0.35 THEN 0.05 + sqrt(u * 0.35 * 0.15) ELSE 0.4 - sqrt((1 - u) * 0.35 * 0.2) END, 6) AS tq, round(CASE WHEN k <= 40 THEN k ** -2.0 / z ELSE 0 END, 6) AS pl,
p_partkey > 1 AND len(list_filter(range(2, floor(sqrt(p_partkey))::BIGINT + 1), lambda d: p_partkey % d = 0)) = 0 AS prime FROM lc""",
    "array_functions": """WITH q AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS x FROM lineitem GROUP BY l_orderkey), m AS (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_quantity AS mode FROM (SELECT l_orderkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) ORDER BY l_orderkey, n DESC, l_quantity)
SELECT l_orderkey, round(list_sum(x), 6) AS total, mode, CASE WHEN len(x) > 1 THEN x[2] END AS second, round(ln(list_sum(list_transform(x, lambda v: exp(v)))), 6) AS lse, round(ln(exp(x[1]) + exp(x[1] + 1)), 6) AS lol, round(1 / (1 + exp(-x[1] / 100)), 6) AS sig, round(ln(1 + exp(x[1] / 100)), 6) AS soft,
round(x[1] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS unit, round(2.01 * list_sum(x), 6) AS axpy, round(coalesce(list_sum(list_filter(x, lambda v: v <> x[1])), 0), 6) AS left FROM q JOIN m USING (l_orderkey)""",
    "interval_points": "SELECT o_orderkey, ((o_custkey + o_custkey + o_orderkey % 7) // 2)::DOUBLE AS centre FROM orders WHERE o_custkey < 40 AND o_custkey + o_orderkey % 7 > 10",
    "fasta_round_trip": _LETTER, "clustal_round_trip": _LETTER,
    "table_round_trip": "SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer",
}
