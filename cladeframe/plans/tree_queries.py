"""Queries of tree and reconstruction operators: the tree world - region - nation - customer - order, and event sequences of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import reconstruction, trees
from cladeframe.plans import models, tree_sql
from cladeframe.plans.tree import Tree

#: Node numbers of the levels: 0 the root, then regions, nations and customers from these.
REGION, NATION, CUSTOMER = 1, 1_000, 1_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of places: a region's branch is as long as its number of letters, a nation's too, a customer's is its balance's size."""
    root = spark.range(1).select(F.lit("world").alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("world").alias("label"), F.lit(0.0).alias("dist"))
    row = lambda d, node, parent, label, dist: d.select(F.lit("world").alias("tree"), node.cast("long").alias("node"), parent.cast("long").alias("parent"), label.alias("label"), dist.cast("double").alias("dist"))
    r = row(_t(spark, sf_dir, "region"), F.col("r_regionkey") + REGION, F.lit(0), F.col("r_name"), F.length("r_name"))
    n = row(_t(spark, sf_dir, "nation"), F.col("n_nationkey") + NATION, F.col("n_regionkey") + REGION, F.col("n_name"), F.length("n_name"))
    c = row(_t(spark, sf_dir, "customer"), F.col("c_custkey") + CUSTOMER, F.col("c_nationkey") + NATION, F.col("c_name"), F.abs("c_acctbal") / 1000)
    return root.unionByName(r).unionByName(n).unionByName(c)


_WORLD = f"""world AS (SELECT 0::BIGINT AS node, NULL::BIGINT AS parent, 'world' AS label, 0::DOUBLE AS dist
UNION ALL SELECT r_regionkey + {REGION}, 0, r_name, length(r_name) FROM region UNION ALL SELECT n_nationkey + {NATION}, n_regionkey + {REGION}, n_name, length(n_name) FROM nation
UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey + {NATION}, c_name, abs(c_acctbal) / 1000 FROM customer)"""
_UP = f"""WITH RECURSIVE {_WORLD}, up AS (SELECT node, node AS anc, 0 AS steps, 0::DOUBLE AS d FROM world UNION ALL SELECT up.node, w.parent, steps + 1, d + w.dist FROM up JOIN world w ON up.anc = w.node WHERE w.parent IS NOT NULL)"""


def tree_depths(spark, sf_dir):
    return trees.with_depth(world(spark, sf_dir)).select("node", "depth", F.round("root_dist", 6).alias("root_dist"))


def tree_leaf_counts(spark, sf_dir):
    return trees.leaf_counts(world(spark, sf_dir)).select("node", "n_leaves")


def tree_subtree(spark, sf_dir):
    """The trees below the regions' names that begin with A."""
    w = world(spark, sf_dir)
    top = w.where(F.col("node").between(REGION, NATION - 1) & F.col("label").startswith("A")).select("tree", "node")
    return trees.subtree(w, top).select("node", "parent", "label")


def tree_pruned(spark, sf_dir):
    """Without the customers in debt; places that lose all of theirs go too."""
    w = world(spark, sf_dir)
    gone = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("world").alias("tree"), (F.col("c_custkey") + CUSTOMER).alias("node"))
    return trees.pruned(w, gone).select("node", "parent")


def tree_relabelled(spark, sf_dir):
    return trees.relabelled(world(spark, sf_dir)).select("node", "label")


def tree_leaf_distances(spark, sf_dir):
    return trees.leaf_root_distribution(world(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def _user_tree() -> Tree:
    """A balanced tree of 8 groups of users: ((g0,g1),(g2,g3)),((g4,g5),(g6,g7))."""
    labels = ("root", "l", "r", "ll", "lr", "rl", "rr", *(f"g{i}" for i in range(8)))
    return Tree(labels, (-1, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6), (0.0, *([0.3] * 14)))


def _group_states(spark, sf_dir):
    """site (a day), leaf (user group), state: each group's most frequent event type that day (ties to the smaller name)."""
    e = _t(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("site"), F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("leaf"), "event_type")
    n = e.groupBy("site", "leaf", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("site", "leaf").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("x")).select("site", "leaf", F.col("x.event_type").alias("state"))


def parsimony_states(spark, sf_dir):
    return reconstruction.parsimony(_group_states(spark, sf_dir), _user_tree())


def _event_model(spark, sf_dir):
    kinds = sorted(r[0] for r in _t(spark, sf_dir, "events").select("event_type").distinct().collect())
    return models.jc(tuple(kinds))


def joint_states(spark, sf_dir):
    return reconstruction.joint(_group_states(spark, sf_dir), _user_tree(), _event_model(spark, sf_dir)).withColumn("log_likelihood", F.round("log_likelihood", 6))


def marginal_root(spark, sf_dir):
    return reconstruction.marginal(_group_states(spark, sf_dir), _user_tree(), _event_model(spark, sf_dir), "root").withColumns({c: F.round(c, 6) for c in ("p", "log_likelihood")})


QUERIES = {f.__name__: f for f in (tree_depths, tree_leaf_counts, tree_subtree, tree_pruned, tree_relabelled, tree_leaf_distances, parsimony_states, joint_states, marginal_root)}

_KNOWN = "SELECT site, node, s FROM (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS site, 'g' || (user_id % 8) AS node, event_type AS s, row_number() OVER (PARTITION BY site, node ORDER BY count(*) DESC, event_type) AS i FROM events GROUP BY 1, 2, 3) WHERE i = 1"
_LETTERS = "SELECT DISTINCT event_type AS s FROM events"

ORACLE_SQL = {
    "parsimony_states": f"WITH {tree_sql.parsimony(_KNOWN)} SELECT best.site, node, s AS state, score FROM best JOIN score ON best.site = score.site",
    "joint_states": f"WITH {tree_sql.joint(_KNOWN, _LETTERS, 0.3)} SELECT best.site, node, s AS state, round(lp, 6) AS log_likelihood FROM best JOIN top ON best.site = top.site",
    "marginal_root": f"WITH {tree_sql.root_posterior(_KNOWN, _LETTERS, 0.3)} SELECT site, s AS state, round(p, 6) AS p, round(lp, 6) AS log_likelihood FROM post",
    "tree_depths": f"{_UP} SELECT node, max(steps)::INT AS depth, round(max(d), 6) AS root_dist FROM up GROUP BY node",
    "tree_leaf_counts": f"{_UP} SELECT anc AS node, count(*) AS n_leaves FROM up WHERE node NOT IN (SELECT parent FROM world WHERE parent IS NOT NULL) GROUP BY anc",
    "tree_subtree": f"{_UP}, top AS (SELECT node FROM world WHERE node BETWEEN {REGION} AND {NATION - 1} AND label LIKE 'A%') SELECT DISTINCT w.node, CASE WHEN w.node IN (SELECT node FROM top) THEN NULL ELSE w.parent END AS parent, w.label FROM world w JOIN up ON w.node = up.node WHERE up.anc IN (SELECT node FROM top)",
    "tree_pruned": f"""{_UP}, gone AS (SELECT c_custkey + {CUSTOMER} AS node FROM customer WHERE c_acctbal < 0), alive AS (SELECT DISTINCT anc AS node FROM up WHERE node >= {CUSTOMER} AND node NOT IN (SELECT node FROM gone))
SELECT node, parent FROM world WHERE node IN (SELECT node FROM alive)""",
    "tree_relabelled": f"WITH {_WORLD}, inner_n AS (SELECT DISTINCT parent AS node FROM world WHERE parent IS NOT NULL), k AS (SELECT node, 'N' || (row_number() OVER (ORDER BY node) - 1) AS lab FROM inner_n) SELECT w.node, coalesce(lab, label) AS label FROM world w LEFT JOIN k USING (node)",
    "tree_leaf_distances": f"{_UP} SELECT round(avg(d), 6) AS mean, round(var_pop(d), 6) AS variance FROM (SELECT node, max(d) AS d FROM up WHERE node NOT IN (SELECT parent FROM world WHERE parent IS NOT NULL) GROUP BY node)",
}
