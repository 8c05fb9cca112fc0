"""Partial-order graphs as rows: nodes (graph, pos, sym, n) and edges (graph, from_pos, to_pos, n, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.operators import intervals, paths


def edges_of(rows: DataFrame, graph: str, sequence: str, order: str, node: str) -> DataFrame:
    """graph, from_node, to_node, n, weight of sequences threaded through nodes: how many steps go between two nodes, and
    the share of them among those that leave the first. The start is null; so is the end."""
    w = W.partitionBy(graph, sequence).orderBy(order)
    steps = rows.select(graph, F.col(node).alias("from_node"), F.lead(node).over(w).alias("to_node"), F.row_number().over(w).alias("__i"), F.col(node).alias("__n"))
    start = steps.where("__i = 1").select(graph, F.lit(None).cast("string").alias("from_node"), F.col("__n").alias("to_node"))
    n = steps.select(graph, "from_node", "to_node").unionByName(start).groupBy(graph, "from_node", "to_node").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", F.col("n") / F.sum("n").over(W.partitionBy(graph, "from_node")))


def node_distribution(rows: DataFrame, graph: str, pos: str, sym: str) -> DataFrame:
    """Counts and shares of symbols at each position; nulls are gaps and left out."""
    n = rows.where(F.col(sym).isNotNull()).groupBy(graph, pos, sym).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(graph, pos)))


def skip_overs(edges: DataFrame) -> DataFrame:
    """graph, from_pos, skipped: positions that the edges of a node jump over."""
    return edges.groupBy("graph", "from_pos").agg(F.sum(F.col("to_pos") - F.col("from_pos") - 1).alias("skipped"))


def jumps(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("to_pos") - F.col("from_pos") > 1)


def edge_rates(jumps: DataFrame, lengths: DataFrame) -> DataFrame:
    """graph, from_pos, to_pos, rate: (1 + the lengths of the sequences that have the edge) / (edges from that node + the lengths of all sequences of the
    graph). ``jumps``: graph, leaf, from_pos, to_pos; ``lengths``: graph, leaf, n. Sequences without a length count as 0."""
    total = lengths.groupBy("graph").agg(F.sum("n").alias("__t"))
    e = jumps.select("graph", "leaf", "from_pos", "to_pos").distinct().join(lengths.select("graph", "leaf", F.col("n").alias("__n")), ["graph", "leaf"], "left")
    e = e.groupBy("graph", "from_pos", "to_pos").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n")).join(total, "graph", "left")
    targets = F.count(F.lit(1)).over(W.partitionBy("graph", "from_pos"))
    return e.select("graph", "from_pos", "to_pos", ((1 + F.col("__n")) / (targets + F.coalesce("__t", F.lit(0)))).alias("rate"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of either graph, with the sum of their support."""
    return a.unionByName(b).groupBy("graph", "from_pos", "to_pos").agg(F.sum("n").alias("n"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("graph", "from_pos", "to_pos"), ["graph", "from_pos", "to_pos"], "left_semi")


def complement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of the first graph alone."""
    return a.join(b.select("graph", "from_pos", "to_pos"), ["graph", "from_pos", "to_pos"], "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return complement(a, b).withColumn("side", F.lit("a")).unionByName(complement(b, a).withColumn("side", F.lit("b")))


def precluded(edges: DataFrame, chosen: DataFrame, bin_width: int = 8) -> DataFrame:
    """Edges that a chosen one of their graph rules out: they begin or end strictly within it. Ends meet the chosen edges' insides in bins."""
    inside = chosen.select("graph", (F.col("from_pos") + 1).alias("lo"), (F.col("to_pos") - 1).alias("hi")).where("lo <= hi")
    ends = edges.select("graph", "from_pos", "to_pos", F.explode(F.array("from_pos", "to_pos")).alias("lo")).withColumn("hi", F.col("lo"))
    hit = intervals.overlap_join(ends, inside, bin_width, on=["graph"]).select("graph", "from_pos", "to_pos").distinct()
    return edges.join(hit, ["graph", "from_pos", "to_pos"], "left_semi").distinct()


def _priced(edges: DataFrame) -> DataFrame:
    return edges.select("graph", "from_pos", "to_pos", paths.edge_cost(F.col("weight"), F.col("recip")).alias("cost"))


def best_paths(edges: DataFrame, width: int) -> DataFrame:
    """graph, step, pos, cost: the cheapest path from -1 to ``width`` of every graph that has one. An edge costs its weight, a thousand times that if it isn't
    reciprocated; ties to the smaller predecessor. Edges may go either way; a graph may be of any size (:mod:`cladeframe.operators.paths`)."""
    return paths.cheapest(_priced(edges), -1, width)


def searched(edges: DataFrame, width: int) -> DataFrame:
    """graph, from_pos, to_pos, cost, before, after, steps_before, steps_after: each edge with its cost (as for :func:`best_paths`), the cheapest way from -1 to
    where it begins and from where it ends to ``width``, and the fewest edges of such ways; infinite, and null, where there is none."""
    return paths.ways(_priced(edges), -1, width)


def optimal_edges(edges: DataFrame, width: int) -> DataFrame:
    """graph, from_pos, to_pos, cost: the edges of all cheapest paths from -1 to ``width`` (ties to nine digits), with what such a path costs."""
    x = searched(edges, width).withColumn("__t", F.col("before") + F.col("cost") + F.col("after")).where(F.col("__t") < float("inf"))
    best = F.min("__t").over(W.partitionBy("graph"))
    return x.withColumn("__b", best).where(F.col("__t") - F.col("__b") <= 1e-9 * F.abs("__b")).select("graph", "from_pos", "to_pos", F.col("__b").alias("cost"))


def depths(edges: DataFrame, width: int) -> DataFrame:
    """graph, pos, to_start, to_end: the fewest edges between a position and either end; null where no path leads there."""
    x = searched(edges, width)
    ends = x.select("graph", F.col("from_pos").alias("pos"), F.col("steps_before").alias("s"), (F.col("steps_after") + 1).alias("e"))
    both = ends.unionByName(x.select("graph", F.col("to_pos").alias("pos"), (F.col("steps_before") + 1).alias("s"), F.col("steps_after").alias("e")))
    return both.where(F.col("pos").between(0, width - 1)).groupBy("graph", "pos").agg(F.min("s").alias("to_start"), F.min("e").alias("to_end"))


def nibbled(edges: DataFrame, width: int) -> DataFrame:
    """Edges that lie on a path from -1 to ``width``; dead ends from either side go."""
    return paths.connecting(edges, -1, width)


def contiguous(edges: DataFrame, width: int) -> DataFrame:
    """graph: those with a path from -1 to ``width``."""
    e = paths.blocked(edges.select("graph", "from_pos", "to_pos", F.lit(1.0).alias("cost")))
    start = e.select("graph").distinct().withColumn("pos", F.lit(-1).cast("long"))
    return paths.distances(e, start).where(F.col("pos") == width).select("graph")


def repaired(edges: DataFrame, fallback: DataFrame, width: int) -> DataFrame:
    """graph, from_pos, to_pos, recip: graphs without a path from end to end get the edges that ``fallback`` has for them; the others keep theirs. A graph that is broken
    in both has the fallback's edges."""
    whole, columns = contiguous(edges, width), ["graph", "from_pos", "to_pos", "recip"]
    broken = edges.select("graph").distinct().join(whole, "graph", "left_anti")
    return edges.select(columns).join(whole, "graph", "left_semi").unionByName(fallback.select(columns).join(broken, "graph", "left_semi"))


def dot_text(edges: DataFrame) -> DataFrame:
    """One line of graph text for each edge, for a text sink."""
    return edges.select("graph", F.concat(F.col("from_pos").cast("string"), F.lit(" -> "), F.col("to_pos").cast("string"), F.lit(";")).alias("value"))


def json_text(edges: DataFrame) -> DataFrame:
    """graph and value: a JSON document for each graph with its sorted edges."""
    return edges.groupBy("graph").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.array("from_pos", "to_pos"))).alias("Edgeindices"), F.lit(True).alias("Directed"))).alias("value"))
