"""Queries of ancestral sequences: an alignment whose width grows with the events, its ancestors' graphs, position trees, states and sequences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import ancestors, reconstruction
from cladeframe.operators import graph_alignment as alignment
from cladeframe.plans import models, tree_sql
from cladeframe.plans.session import checkpointed
from cladeframe.plans.tree_queries import _user_tree

#: Events of neighbouring ids that make up a position.
EACH = 64


def _alignment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """leaf, pos, sym: for each group of users and run of event ids the first letter of its last event's type, if that event's id is odd, else a gap; and the number of runs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("leaf"), F.floor(F.col("event_id") / EACH).cast("long").alias("pos"), "event_id", F.upper(F.substring("event_type", 1, 1)).alias("letter"))
    m = e.groupBy("leaf", "pos").agg(F.max(F.struct("event_id", "letter")).alias("x"))
    al = checkpointed(m.select("leaf", "pos", F.when(F.col("x.event_id") % 2 == 1, F.col("x.letter")).alias("sym")))
    return al, (al.agg(F.max("pos")).first()[0] or 0) + 1


def _model(spark: SparkSession, sf_dir: str) -> models.Model:
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.upper(F.substring("event_type", 1, 1)).alias("s")).distinct().collect()  # letters
    return models.jc(tuple(sorted(r[0] for r in kinds)))


def _present(spark, sf_dir):
    al, width = _alignment(spark, sf_dir)
    edges = checkpointed(reconstruction.bidirectional_edge_parsimony(al, _user_tree(), width))
    return al, width, edges, ancestors.occupied(al, edges, width)


def ancestor_sequences(spark, sf_dir):
    """Every ancestor's sequence along its preferred path."""
    al, width = _alignment(spark, sf_dir)
    return ancestors.sequences(al, _user_tree(), _model(spark, sf_dir), width).withColumn("cost", F.round("cost", 6))


def position_trees(spark, sf_dir):
    return ancestors.position_trees(_present(spark, sf_dir)[3], _user_tree())


def _marked(spark, sf_dir):
    """site and node: positions where a group of users, or all groups below an ancestor, have a number of events that leaves 1 when divided by 3."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("leaf"), F.floor(F.col("event_id") / EACH).cast("long").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    above = ancestors.leaves_below(spark, _user_tree())
    every = e.select("site", F.col("leaf").alias("node"), "n").unionByName(e.join(above, "leaf").select("site", "node", "n"))
    return every.groupBy("site", "node").agg(F.sum("n").alias("n")).where("n % 3 = 1").select("site", "node")


def position_orphans(spark, sf_dir):
    """Marked nodes that nothing marked connects to a group of users."""
    present = checkpointed(_marked(spark, sf_dir))
    return ancestors.position_trees(present, _user_tree(), orphans=True).join(ancestors.position_trees(present, _user_tree()), ["site", "node"], "left_anti").select("site", "node", "parent")


def position_states(spark, sf_dir):
    """States of ancestors at the positions that they have."""
    al, _, _, present = _present(spark, sf_dir)
    sites = al.select(F.col("pos").alias("site"), "leaf", F.col("sym").alias("state"))
    return ancestors.joint_states(sites, ancestors.position_trees(present, _user_tree()), _user_tree(), _model(spark, sf_dir)).withColumn("log_likelihood", F.round("log_likelihood", 6))


def regained_positions(spark, sf_dir):
    """Marked nodes below one that isn't."""
    return ancestors.regained(_marked(spark, sf_dir), _user_tree())


def ancestors_outside(spark, sf_dir):
    """Ancestors with an edge that no sequence has."""
    al, width, edges, _ = _present(spark, sf_dir)
    return ancestors.outside_alignment(edges, al, width)


def _name_graphs(spark, sf_dir):
    """Nodes and edges of a graph for each type of part: every tenth part's name, letter by letter; all other parts' names as sequences; and where the graphs end, the length of the longest name."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_type").alias("graph"), F.col("p_name").alias("text"))
    width = p.agg(F.max(F.length("text"))).first()[0] or 0
    letters = p.where("p_partkey % 10 = 0").select("graph", "p_partkey", F.posexplode(F.split("text", ""))).where("col <> ''").select("graph", "p_partkey", F.col("pos").cast("long").alias("pos"), F.col("col").alias("sym"))
    nodes = letters.groupBy("graph", "pos", "sym").agg(F.count(F.lit(1)).alias("n"))
    last = letters.groupBy("graph", "p_partkey").agg(F.max("pos").alias("from_pos")).select("graph", "from_pos", F.lit(width).cast("long").alias("to_pos"))
    edges = letters.select("graph", (F.col("pos") - 1).alias("from_pos"), F.col("pos").alias("to_pos")).unionByName(last).groupBy("graph", "from_pos", "to_pos").agg(F.count(F.lit(1)).alias("n"))
    return nodes, edges, p.where("p_partkey % 10 <> 0").select("graph", F.col("p_partkey").cast("string").alias("seq"), "text"), width


def graph_alignment(spark, sf_dir):
    """Scores of parts' names along the graph of their type's names."""
    nodes, edges, names, width = _name_graphs(spark, sf_dir)
    return alignment.align(nodes, edges, names, width).groupBy("graph", "seq").agg(F.round(F.max("score"), 6).alias("score"))


def graph_next_version(spark, sf_dir):
    """How many symbols the graphs have once all names are threaded in: as many as the names have letters."""
    nodes, edges, names, width = _name_graphs(spark, sf_dir)
    new, _ = alignment.threaded(alignment.align(nodes, edges, names, width), nodes, edges, width)
    return new.groupBy("graph").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (ancestor_sequences, position_trees, position_orphans, position_states, regained_positions, ancestors_outside, graph_alignment, graph_next_version)}

_AL = f"al AS MATERIALIZED (SELECT 'g' || (user_id % 8) AS leaf, event_id // {EACH} AS pos, CASE WHEN max(event_id) % 2 = 1 THEN upper(max_by(event_type, event_id)[1]) END AS sym FROM events GROUP BY ALL), wd AS (SELECT max(pos) + 1 AS width FROM al)"
_JUMPS = "o AS (SELECT leaf, pos, lag(pos) OVER w AS prev, coalesce(lead(pos) OVER w, width) AS nxt FROM al, wd WHERE sym IS NOT NULL WINDOW w AS (PARTITION BY leaf ORDER BY pos)), j AS MATERIALIZED (SELECT leaf, pos AS from_pos, nxt::BIGINT AS to_pos FROM o UNION ALL SELECT leaf, -1, pos FROM o WHERE prev IS NULL)"
_SITES = "SELECT from_pos * 2 + 2 AS site, leaf AS node, to_pos::VARCHAR AS s FROM j UNION ALL SELECT to_pos * 2 + 3, leaf, from_pos::VARCHAR FROM j"


def _edges(of: str = "best") -> str:
    """CTE ``e``: node, from_pos, to_pos, recip of the ancestors."""
    return f"""f0 AS (SELECT node, CASE WHEN site % 2 = 0 THEN site // 2 - 1 ELSE s::BIGINT END AS from_pos, CASE WHEN site % 2 = 0 THEN s::BIGINT ELSE (site - 3) // 2 END AS to_pos, site % 2 = 0 AS f FROM {of} WHERE node IN {tree_sql.INNER}),
e AS MATERIALIZED (SELECT node, from_pos, to_pos, bool_or(f) AND bool_or(NOT f) AS recip FROM f0 GROUP BY ALL)"""


#: Up to ``pr`` (site, node): positions that nodes have; ``ne``: ancestors' edges on paths from end to end.
_PRESENT = f"""{_AL}, {_JUMPS}, {tree_sql.parsimony(_SITES)}, {_edges()},
fw(node, pos) AS (SELECT DISTINCT node, -1::BIGINT FROM e UNION SELECT e.node, e.to_pos FROM fw JOIN e ON e.node = fw.node AND e.from_pos = fw.pos),
bw(node, pos) AS (SELECT DISTINCT e.node, width FROM e, wd UNION SELECT e.node, e.from_pos FROM bw JOIN e ON e.node = bw.node AND e.to_pos = bw.pos),
ne AS MATERIALIZED (SELECT e.* FROM e JOIN fw ON fw.node = e.node AND fw.pos = from_pos JOIN bw ON bw.node = e.node AND bw.pos = to_pos),
pr0 AS MATERIALIZED (SELECT pos AS site, leaf AS node FROM al WHERE sym IS NOT NULL UNION SELECT pos, node FROM (SELECT node, from_pos AS pos FROM ne UNION SELECT node, to_pos FROM ne), wd WHERE pos BETWEEN 0 AND width - 1)"""
#: Up to ``pt`` (site, node, parent, top): trees of positions, orphans too, and the root of each part.
_PARTS = """p1 AS MATERIALIZED (SELECT p.site, p.node, q.node AS parent FROM pr0 p LEFT JOIN tr ON tr.node = p.node LEFT JOIN pr0 q ON q.site = p.site AND q.node = tr.parent),
up(site, node, above) AS (SELECT site, node, node FROM p1 UNION SELECT up.site, up.node, p1.parent FROM up JOIN p1 ON p1.site = up.site AND p1.node = up.above WHERE p1.parent IS NOT NULL),
tops AS MATERIALIZED (SELECT up.site, up.node, up.above AS top FROM up JOIN p1 ON p1.site = up.site AND p1.node = up.above WHERE p1.parent IS NULL),
fed AS MATERIALIZED (SELECT DISTINCT site, top FROM tops WHERE node[1] = 'g')"""
_TREES = f"{_PRESENT}, {_PARTS}"
_MARKED = f"""{tree_sql._EDGES}, ev AS (SELECT 'g' || (user_id % 8) AS node, event_id // {EACH} AS site, count(*) AS n FROM events GROUP BY ALL), ab(leaf, node) AS (SELECT node, node FROM tr WHERE node[1] = 'g' UNION SELECT ab.leaf, tr.parent FROM ab JOIN tr ON tr.node = ab.node),
pr0 AS MATERIALIZED (SELECT site, ab.node FROM ev JOIN ab ON ab.leaf = ev.node GROUP BY ALL HAVING sum(n) % 3 = 1)"""
_OWN = "SELECT p1.site, p1.node, p1.parent FROM p1 JOIN tops t ON t.site = p1.site AND t.node = p1.node"


def _states() -> str:
    """The joint states of position trees: its own names for the steps, as those of parsimony are taken."""
    masked = tree_sql.masked("SELECT pos AS site, leaf AS node, sym AS s FROM al WHERE sym IS NOT NULL", "SELECT site, node FROM kept", "SELECT DISTINCT upper(event_type[1]) AS s FROM events", 0.3)
    return f"kept AS MATERIALIZED ({_OWN} SEMI JOIN fed ON fed.site = t.site AND fed.top = t.top),\n{masked}"


def _renamed(sql: str) -> str:
    """The names of the parsimony's steps set apart from those of the likelihood's."""
    return re.sub(r"\b(lv|known|free|leafs|states|best|score|[bc][0-3])\b", r"pars_\1", sql)


_FIRST = _renamed(_TREES)
_SUPPORT = """below(node, leaf) AS (SELECT parent, node FROM tr WHERE node[1] = 'g' UNION SELECT tr.parent, b.leaf FROM below b JOIN tr ON tr.node = b.node),
len AS (SELECT leaf, count(*) AS n FROM al WHERE sym IS NOT NULL GROUP BY leaf), tot AS (SELECT node, sum(n) AS n FROM below JOIN len USING (leaf) GROUP BY node),
used AS (SELECT node, from_pos, to_pos, sum(n) AS n FROM j JOIN below USING (leaf) JOIN len USING (leaf) GROUP BY ALL),
we AS MATERIALIZED (SELECT ne.node, ne.from_pos, ne.to_pos, CASE WHEN recip THEN 1 ELSE 1000 END * CASE WHEN ne.from_pos < 0 THEN 0::DOUBLE ELSE least(-ln((1 + coalesce(u.n, 0)) / (count(*) OVER (PARTITION BY ne.node, ne.from_pos) + coalesce(tot.n, 0))), 10000) END AS w
  FROM ne LEFT JOIN used u ON u.node = ne.node AND u.from_pos = ne.from_pos AND u.to_pos = ne.to_pos LEFT JOIN tot ON tot.node = ne.node),
""" + tree_sql.WAY

ORACLE_SQL = {
    "graph_alignment": """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_type AS graph, p_name AS text FROM part), wd AS (SELECT max(len(text)) AS width FROM p), l AS (SELECT graph, k, i - 1 AS pos, text[i] AS sym FROM (SELECT *, unnest(range(1, len(text) + 1)) AS i FROM p WHERE k % 10 = 0)),
nd AS (SELECT graph, pos, sym, count(*) / sum(count(*)) OVER (PARTITION BY graph, pos) AS p FROM l GROUP BY graph, pos, sym), ed AS (SELECT DISTINCT graph, pos - 1 AS f, pos AS t FROM l UNION SELECT graph, max(pos), width FROM l, wd GROUP BY graph, k, width),
mv AS (SELECT graph, f, t, 'match' AS m FROM ed, wd WHERE t < width UNION ALL SELECT graph, f, t, CASE WHEN t = width THEN 'end' ELSE 'skip' END FROM ed, wd UNION ALL SELECT DISTINCT graph, f, f, 'gap' FROM ed),
sq AS (SELECT DISTINCT graph, text FROM p WHERE k % 10 <> 0),
c(k, graph, text, pos, j, s) AS (SELECT 0, graph, text, -1::BIGINT, 0::BIGINT, 0::DOUBLE FROM sq
  UNION ALL SELECT k + 1, c.graph, c.text, mv.t, CASE WHEN m IN ('skip', 'end') THEN j ELSE j + 1 END, max(s + CASE WHEN m IN ('gap', 'skip') THEN -2 WHEN m = 'end' THEN 0 ELSE 3 * coalesce(nd.p, 0) - 1 END)
  FROM c JOIN mv ON mv.graph = c.graph AND mv.f = c.pos LEFT JOIN nd ON nd.graph = mv.graph AND nd.pos = mv.t AND m = 'match' AND nd.sym = c.text[j + 1] WHERE m IN ('skip', 'end') OR j < len(c.text) GROUP BY ALL),
b AS (SELECT graph, text, max(s) AS s FROM c, wd WHERE pos = width AND j = len(text) GROUP BY ALL)
SELECT p.graph, p.k::VARCHAR AS seq, round(s, 6) AS score FROM p JOIN b ON b.graph = p.graph AND b.text = p.text WHERE p.k % 10 <> 0""",
    "graph_next_version": "SELECT p_type AS graph, sum(len(p_name))::BIGINT AS n FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_partkey % 10 = 0) GROUP BY p_type",
    "position_trees": f"WITH RECURSIVE {_TREES} {_OWN} SEMI JOIN fed ON fed.site = t.site AND fed.top = t.top",
    "position_orphans": f"WITH RECURSIVE {_MARKED}, {_PARTS} {_OWN} ANTI JOIN fed ON fed.site = t.site AND fed.top = t.top",
    "position_states": f"WITH RECURSIVE {_FIRST}, {_states()} SELECT b.site, b.node, b.s AS state, round(top.lp, 6) AS log_likelihood FROM best b JOIN top ON top.site = b.site",
    "regained_positions": f"""WITH RECURSIVE {_MARKED}, every AS (SELECT DISTINCT site FROM pr0),
lost(site, node) AS (SELECT every.site, tr.node FROM every CROSS JOIN tr LEFT JOIN pr0 p ON p.site = every.site AND p.node = tr.node WHERE p.node IS NULL UNION SELECT lost.site, tr.node FROM lost JOIN tr ON tr.parent = lost.node)
SELECT lost.site, lost.node FROM lost JOIN pr0 p ON p.site = lost.site AND p.node = lost.node""",
    "ancestors_outside": f"WITH {_AL}, {_JUMPS}, {tree_sql.parsimony(_SITES)}, {_edges()}, n AS (SELECT DISTINCT node FROM e ANTI JOIN j ON j.from_pos = e.from_pos AND j.to_pos = e.to_pos), c AS (SELECT count(DISTINCT node) AS ancestors FROM e) SELECT ancestors, (SELECT count(*) FROM n) AS outside, (SELECT count(*) FROM n) / ancestors AS share FROM c",
    "ancestor_sequences": f"""WITH RECURSIVE {_FIRST}, {_states()}, {_SUPPORT},
letters2 AS (SELECT way.node, way.pos, coalesce(b.s, '?') AS s FROM way, wd LEFT JOIN best b ON b.site = way.pos AND b.node = way.node WHERE way.pos BETWEEN 0 AND width - 1),
cells AS (SELECT n.node, p.pos, l.s FROM (SELECT DISTINCT node FROM way) n CROSS JOIN (SELECT unnest(range(width)) AS pos FROM wd) p LEFT JOIN letters2 l ON l.node = n.node AND l.pos = p.pos)
SELECT cells.node, coalesce(string_agg(s, '' ORDER BY cells.pos) FILTER (s IS NOT NULL), '') AS sequence, string_agg(coalesce(s, '-'), '' ORDER BY cells.pos) AS gapped, round(any_value(far.c), 6) AS cost FROM cells JOIN far ON far.node = cells.node JOIN wd ON far.pos = width GROUP BY cells.node""",
}
