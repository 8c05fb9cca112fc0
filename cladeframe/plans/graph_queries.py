"""Queries of partial-order graphs and indels: users' event sequences as sequences through a graph, and hourly presence as an alignment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import annotation, graphs, learning, pair_hmm, reconstruction
from cladeframe.plans import models, tree_sql
from cladeframe.plans.tree_queries import _user_tree

HOURS = 24


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _alignment(spark, sf_dir):
    """leaf, pos, sym: for each group of users and hour of the day, the type of its largest event id if that id is even, else a gap."""
    e = _events(spark, sf_dir).select(F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("leaf"), F.hour("ts").cast("long").alias("pos"), "event_id", "event_type")
    m = e.groupBy("leaf", "pos").agg(F.max(F.struct("event_id", "event_type")).alias("x"))
    return m.select("leaf", "pos", F.when(F.col("x.event_id") % 2 == 0, F.col("x.event_type")).alias("sym"))


_ALIGNMENT = "al AS (SELECT 'g' || (user_id % 8) AS leaf, hour(ts)::BIGINT AS pos, CASE WHEN max(event_id) % 2 = 0 THEN max_by(event_type, event_id) END AS sym FROM events GROUP BY ALL)"


def sequence_graph(spark, sf_dir):
    """Edges between event types over all users' sequences, by parity of the user."""
    e = _events(spark, sf_dir).withColumn("graph", (F.col("user_id") % 2).cast("string")).withColumn("place", F.struct("ts", "event_id"))
    return graphs.edges_of(e, "graph", "user_id", "place", "event_type").withColumn("weight", F.round("weight", 6))


def column_distribution(spark, sf_dir):
    return graphs.node_distribution(_alignment(spark, sf_dir).withColumn("graph", F.lit("all")), "graph", "pos", "sym").withColumn("p", F.round("p", 6))


def alignment_jumps(spark, sf_dir):
    """All jumps between occupied positions with how many sequences have them."""
    return reconstruction.jumps(_alignment(spark, sf_dir), HOURS).groupBy("from_pos", "to_pos").agg(F.count(F.lit(1)).alias("n"))


def gap_statistics(spark, sf_dir):
    s = reconstruction.gap_statistics(_alignment(spark, sf_dir))
    return s.withColumn("mean_gap_length", F.round("mean_gap_length", 6)).withColumn("occupancy", F.round("occupancy", 6))


def graph_skip_overs(spark, sf_dir):
    e = reconstruction.jumps(_alignment(spark, sf_dir), HOURS).select(F.col("leaf").alias("graph"), "from_pos", "to_pos")
    return graphs.skip_overs(e)


def graph_symmetric_difference(spark, sf_dir):
    """Jumps of the first or the second user group alone."""
    e = reconstruction.jumps(_alignment(spark, sf_dir), HOURS)
    side = lambda g: e.where(F.col("leaf") == g).select(F.lit("x").alias("graph"), "from_pos", "to_pos")
    return graphs.symmetric_difference(side("g0"), side("g1")).select("from_pos", "to_pos", "side")


def edge_parsimony(spark, sf_dir):
    """Ancestors' edges by bidirectional edge parsimony."""
    return reconstruction.bidirectional_edge_parsimony(_alignment(spark, sf_dir), _user_tree(), HOURS)


def edge_likelihood(spark, sf_dir):
    """The same by joint likelihood."""
    return reconstruction.bidirectional_edge_likelihood(_alignment(spark, sf_dir), _user_tree(), HOURS)


def simple_indel_coding(spark, sf_dir):
    return reconstruction.simple_indel_coding(_alignment(spark, sf_dir))


def indel_coding_parsimony(spark, sf_dir):
    return reconstruction.indel_coding_parsimony(_alignment(spark, sf_dir), _user_tree(), HOURS)


def ancestor_paths(spark, sf_dir):
    """The preferred path through each ancestor's graph."""
    e = edge_parsimony(spark, sf_dir).withColumnRenamed("node", "graph").withColumn("weight", F.lit(1.0))
    return graphs.best_paths(e, HOURS)


def presence_parsimony(spark, sf_dir):
    return reconstruction.presence_by_parsimony(_alignment(spark, sf_dir), _user_tree())


def graph_repair(spark, sf_dir):
    """Ancestors' edges by likelihood; those of parsimony where an ancestor's graph has no path from end to end."""
    side = lambda e: e.withColumnRenamed("node", "graph")
    return graphs.repaired(side(edge_likelihood(spark, sf_dir)), side(edge_parsimony(spark, sf_dir)), HOURS)


def graph_contiguous(spark, sf_dir):
    """Users' groups whose jumps lead from the first to the last position."""
    e = reconstruction.jumps(_alignment(spark, sf_dir), HOURS).select(F.col("leaf").alias("graph"), "from_pos", "to_pos", F.lit(True).alias("recip"))
    return graphs.contiguous(e, HOURS)


def tree_annotation(spark, sf_dir):
    """The hidden state and predicted mean value of every group of users and its ancestors, by hour."""
    e = _events(spark, sf_dir).select(F.hour("ts").cast("long").alias("site"), F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("leaf"), "value")
    values = e.groupBy("site", "leaf").agg(F.avg("value").alias("value"))
    tree, model = _user_tree(), models.jc(("low", "high"))
    means, variances, _ = annotation.fit_emissions(values, tree, model, rounds=20)
    return annotation.annotated(values, tree, model, means, variances)


def user_type_mixture(spark, sf_dir):
    """component, weight, alphas of a mixture of two Dirichlet distributions over users' counts of event types."""
    e = _events(spark, sf_dir)
    types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    counts = e.groupBy("user_id").agg(F.array(*(F.count_if(F.col("event_type") == t) for t in types)).alias("counts"))
    weights, alphas, _ = learning.dirichlet_mixture(counts, "counts", 2, rounds=20)
    return spark.createDataFrame([(i, w, a) for i, (w, a) in enumerate(zip(weights, alphas))], "component int, weight double, alphas array<double>")


def name_alignments(spark, sf_dir):
    """Each nation's name aligned with its region's."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pairs = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return pair_hmm.hmm_alignments(pairs, pair_hmm.PairModel(symbols=26))


QUERIES = {f.__name__: f for f in (sequence_graph, column_distribution, alignment_jumps, gap_statistics, graph_skip_overs, graph_symmetric_difference, edge_parsimony, edge_likelihood, simple_indel_coding, indel_coding_parsimony, ancestor_paths, presence_parsimony, graph_repair, graph_contiguous, tree_annotation, user_type_mixture, name_alignments)}

_JUMPS = f"{_ALIGNMENT}, o AS (SELECT leaf, pos, lag(pos) OVER w AS prev, coalesce(lead(pos) OVER w, {HOURS}) AS nxt FROM al WHERE sym IS NOT NULL WINDOW w AS (PARTITION BY leaf ORDER BY pos)), j AS (SELECT leaf, pos AS from_pos, nxt::BIGINT AS to_pos FROM o UNION ALL SELECT leaf, -1, pos FROM o WHERE prev IS NULL)"

_SITES = "SELECT from_pos * 2 + 2 AS site, leaf AS node, to_pos::VARCHAR AS s FROM j UNION ALL SELECT to_pos * 2 + 3, leaf, from_pos::VARCHAR FROM j"
_GAPS = f"{_ALIGNMENT}, gaps AS (SELECT leaf, min(pos) AS lo, max(pos) AS hi FROM (SELECT leaf, pos, pos - row_number() OVER (PARTITION BY leaf ORDER BY pos) AS run FROM al WHERE sym IS NULL) GROUP BY leaf, run), inside AS (SELECT i.leaf AS node, c.lo * {HOURS + 1} + c.hi AS site, c.lo = i.lo AND c.hi = i.hi AS same FROM (SELECT DISTINCT lo, hi FROM gaps) c JOIN gaps i ON i.lo <= c.lo AND c.hi <= i.hi)"

_ANCESTORS = """AS (SELECT node, CASE WHEN site % 2 = 0 THEN site // 2 - 1 ELSE s::BIGINT END AS from_pos, CASE WHEN site % 2 = 0 THEN s::BIGINT ELSE (site - 3) // 2 END AS to_pos, site % 2 = 0 AS f FROM {best} WHERE node IN {inner})"""
_GROUPED = "SELECT node, from_pos, to_pos, bool_or(f) AND bool_or(NOT f) AS recip FROM {e} GROUP BY ALL"
_BY_PARSIMONY = f"{_JUMPS}, {tree_sql.parsimony(_SITES)}, f0 {_ANCESTORS.format(best='best', inner=tree_sql.INNER)}, e AS MATERIALIZED ({_GROUPED.format(e='f0')})"
_BY_LIKELIHOOD = f"{tree_sql.joint_recoded(_SITES, 0.3)}, f1 {_ANCESTORS.format(best='best', inner=tree_sql.INNER)}, el AS MATERIALIZED ({_GROUPED.format(e='f1')})"


def _apart(sql: str) -> str:
    """The names of the parsimony's steps set apart from those of the likelihood's."""
    return re.sub(r"\b(tr|lv|known|free|leafs|states|best|score|[bc][0-3])\b", r"pars_\1", sql)


ORACLE_SQL = {
    "edge_likelihood": f"WITH {_JUMPS}, {_BY_LIKELIHOOD} SELECT * FROM el",
    "ancestor_paths": f"""WITH RECURSIVE {_BY_PARSIMONY}, wd AS (SELECT {HOURS}::BIGINT AS width), we AS MATERIALIZED (SELECT node, from_pos, to_pos, CASE WHEN recip THEN 1 ELSE 1000 END::DOUBLE AS w FROM e), {tree_sql.WAY}
SELECT way.node AS graph, (row_number() OVER (PARTITION BY way.node ORDER BY way.pos) - 1)::INT AS step, way.pos, t.c AS cost FROM way JOIN far t ON t.node = way.node AND t.pos = {HOURS}""",
    "graph_repair": f"""WITH RECURSIVE {_apart(_BY_PARSIMONY)}, {_BY_LIKELIHOOD}, fw(node, pos) AS (SELECT DISTINCT node, -1::BIGINT FROM el UNION SELECT el.node, el.to_pos FROM fw JOIN el ON el.node = fw.node AND el.from_pos = fw.pos),
ok AS (SELECT node FROM fw WHERE pos = {HOURS}) SELECT node AS graph, from_pos, to_pos, recip FROM el SEMI JOIN ok ON ok.node = el.node UNION ALL SELECT e.node, e.from_pos, e.to_pos, e.recip FROM e SEMI JOIN el ON el.node = e.node ANTI JOIN ok ON ok.node = e.node""",
    "presence_parsimony": f"WITH {_ALIGNMENT}, {tree_sql.parsimony('SELECT pos AS site, leaf AS node, (sym IS NOT NULL)::INT::VARCHAR AS s FROM al')} SELECT best.site, node, s AS state, score FROM best JOIN score ON best.site = score.site",
    "edge_parsimony": f"""WITH {_JUMPS}, {tree_sql.parsimony(_SITES)},
e AS (SELECT node, CASE WHEN site % 2 = 0 THEN site // 2 - 1 ELSE s::BIGINT END AS from_pos, CASE WHEN site % 2 = 0 THEN s::BIGINT ELSE (site - 3) // 2 END AS to_pos, site % 2 = 0 AS f FROM best WHERE node IN {tree_sql.INNER})
SELECT node, from_pos, to_pos, bool_or(f) AND bool_or(NOT f) AS recip FROM e GROUP BY ALL""",
    "indel_coding_parsimony": f"WITH {_GAPS}, {tree_sql.parsimony("SELECT site, node, '1' AS s FROM inside WHERE same", 'SELECT site, node FROM inside WHERE NOT same', '0')} SELECT (best.site // {HOURS + 1})::BIGINT AS lo, best.site % {HOURS + 1} AS hi, node, s AS state, score FROM best JOIN score ON best.site = score.site",
    "graph_contiguous": f"WITH {_JUMPS} SELECT DISTINCT leaf AS graph FROM j WHERE to_pos = {HOURS}",
    "sequence_graph": """
WITH s AS (SELECT (user_id % 2)::VARCHAR AS graph, event_type AS a, lead(event_type) OVER w AS b, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT graph, a AS from_node, b AS to_node FROM s UNION ALL SELECT graph, NULL, a FROM s WHERE i = 1)
SELECT graph, from_node, to_node, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY graph, from_node), 6) AS weight FROM e GROUP BY graph, from_node, to_node""",
    "column_distribution": f"WITH {_ALIGNMENT} SELECT 'all' AS graph, pos, sym, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pos), 6) AS p FROM al WHERE sym IS NOT NULL GROUP BY pos, sym",
    "alignment_jumps": f"WITH {_JUMPS} SELECT from_pos, to_pos, count(*) AS n FROM j GROUP BY ALL",
    "gap_statistics": f"""
WITH {_ALIGNMENT}, r AS (SELECT *, lag(sym) OVER w AS prev, lag(pos) OVER w AS pp FROM al WINDOW w AS (PARTITION BY leaf ORDER BY pos)),
s AS (SELECT count(*) FILTER (sym IS NULL) AS gaps, count(*) FILTER (sym IS NULL AND (prev IS NOT NULL OR pp IS NULL)) AS gap_starts, count(*) AS cells, count(DISTINCT pos) AS width FROM r)
SELECT gaps, gap_starts, round(gaps / gap_starts, 6) AS mean_gap_length, round(1 - gaps / cells, 6) AS occupancy, trunc((1 - gaps / cells) * width)::INT AS average_length FROM s""",
    "simple_indel_coding": f"""
WITH {_ALIGNMENT}, g AS (SELECT leaf, pos, pos - row_number() OVER (PARTITION BY leaf ORDER BY pos) AS run FROM al WHERE sym IS NULL), i AS (SELECT leaf, min(pos) AS lo, max(pos) AS hi FROM g GROUP BY leaf, run)
SELECT i.leaf, c.lo, c.hi, CASE WHEN c.lo = i.lo AND c.hi = i.hi THEN '1' END AS state FROM (SELECT DISTINCT lo, hi FROM i) c JOIN i ON i.lo <= c.lo AND c.hi <= i.hi""",
    "graph_skip_overs": f"WITH {_JUMPS} SELECT leaf AS graph, from_pos, sum(to_pos - from_pos - 1)::BIGINT AS skipped FROM j GROUP BY ALL",
    "graph_symmetric_difference": f"WITH {_JUMPS}, a AS (SELECT from_pos, to_pos FROM j WHERE leaf = 'g0'), b AS (SELECT from_pos, to_pos FROM j WHERE leaf = 'g1') SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
}
