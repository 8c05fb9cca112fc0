"""Structure of networks kept as rows: edges (net, parent, child). Nodes are named by what the edges say; rows without a parent or child are no edges.

Reachability goes round by round from a frontier: each round joins only what the last one found, leaves out what is known, and is cut off by a reliable
checkpoint, so there are as many rounds as the longest trail has steps, and no more rows than the answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.plans.session import checkpointed


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("net", "parent", "child").dropna().distinct()


#: Rows of one key beyond so many are dealt in pieces.
PIECE_ROWS = 50_000


def _dealt(many: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``many`` with ``__piece``, and the keys that have several pieces with their number, ``__pieces``: one row for every PIECE_ROWS rows of ``many`` at most."""
    hot = checkpointed(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PIECE_ROWS).select(*keys, F.ceil(F.col("__n") / PIECE_ROWS).alias("__pieces")))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__piece", F.pmod(F.xxhash64(*many.columns), F.coalesce("__pieces", F.lit(1).cast("long"))))
    return dealt.select(*many.columns, "__piece"), hot


def _heard(few: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``few``, once for each piece of their key."""
    last = F.coalesce("__pieces", F.lit(1).cast("long")) - 1
    return few.join(F.broadcast(hot), keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*few.columns, "__piece")


def _met(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, where one key may have very many rows of ``many``: none of its tasks gets all of them."""
    dealt, hot = _dealt(many, keys)
    return dealt.join(_heard(few, hot, keys), [*keys, "__piece"], how).drop("__piece")


def reached(start: DataFrame, moves: DataFrame) -> DataFrame:
    """What can be reached from the rows of ``start``, themselves included. ``moves`` has the columns of ``start`` and, as ``to_<column>``, where a move from them
    leads; ``net`` stays as it is."""
    keys = start.columns
    dealt, hot = _dealt(checkpointed(moves), keys)
    dealt = dealt if hot.isEmpty() else checkpointed(dealt)
    found = [checkpointed(start.dropna().distinct())]
    while not found[-1].isEmpty():
        seen = reduce(DataFrame.unionByName, found)
        step = _heard(found[-1], hot, keys).join(dealt, [*keys, "__piece"]).select(*(F.col("net") if c == "net" else F.col(f"to_{c}").alias(c) for c in keys)).distinct()
        found.append(checkpointed(step.join(seen, keys, "left_anti")))
    return reduce(DataFrame.unionByName, found)


def ancestors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """net, node: all ancestors of the nodes of ``of`` (net, node). Those themselves aren't in it unless another has them for an ancestor."""
    up = _edges(edges).select("net", F.col("child").alias("node"), F.col("parent").alias("to_node"))
    first = of.select("net", "node").distinct().join(up, ["net", "node"]).select("net", F.col("to_node").alias("node"))
    return reached(first, up)


def markov_blanket(edges: DataFrame, of: DataFrame) -> DataFrame:
    """net, node, member: the parents, children and children's other parents of each node of ``of`` (net, node)."""
    e, q = checkpointed(_edges(edges)), of.select("net", "node").distinct()
    children = _met(e, q.withColumnRenamed("node", "parent"), ["net", "parent"]).select("net", F.col("parent").alias("node"), F.col("child").alias("member"))
    parents = e.join(q.withColumnRenamed("node", "child"), ["net", "child"]).select("net", F.col("child").alias("node"), F.col("parent").alias("member"))
    others = children.withColumnRenamed("member", "child").join(e, ["net", "child"]).where(F.col("parent") != F.col("node")).select("net", "node", F.col("parent").alias("member"))
    return children.unionByName(parents).unionByName(others).distinct()


def relevant(edges: DataFrame, query: DataFrame, known: DataFrame) -> DataFrame:
    """net, node: ancestors of the queried nodes that aren't known, and of the known ones (both net, node)."""
    open_ = query.select("net", "node").join(known.select("net", "node"), ["net", "node"], "left_anti")
    return ancestors(edges, open_.unionByName(known.select("net", "node")))


def d_connected(edges: DataFrame, query: DataFrame, known: DataFrame) -> DataFrame:
    """net, node: nodes that an active trail from a queried node comes to, given the known ones (all net, node); the queried ones and
    known nodes where a trail ends are in it. A ball goes up or down: up from an unknown node to its parents and children, down from an unknown
    one to its children, and down into a known node, or an ancestor of one, up again to its parents."""
    e, k = checkpointed(_edges(edges)), known.select("net", "node").distinct()
    converging = ancestors(edges, k).unionByName(k).distinct()
    child_known, parent_known = k.withColumnRenamed("node", "child"), k.withColumnRenamed("node", "parent")
    move = lambda rows, node, up, to, to_up: rows.select("net", F.col(node).alias("node"), F.lit(up).alias("up"), F.col(to).alias("to_node"), F.lit(to_up).alias("to_up"))
    from_child, from_parent = e.join(child_known, ["net", "child"], "left_anti"), _met(e, parent_known, ["net", "parent"], "left_anti")
    back = e.join(converging.withColumnRenamed("node", "child"), ["net", "child"], "left_semi")
    moves = [move(from_child, "child", True, "parent", True), move(from_parent, "parent", True, "child", False), move(from_parent, "parent", False, "child", False), move(back, "child", False, "parent", True)]
    balls = reached(query.select("net", "node", F.lit(True).alias("up")), reduce(DataFrame.unionByName, moves))
    return balls.select("net", "node").distinct()


def topological_levels(edges: DataFrame) -> DataFrame:
    """net, node, level: the number of edges on the longest path to a node from one without parents; sorting by it is a topological order. A round
    frees the nodes whose last parent the round before has freed. Raises ValueError if edges form a cycle."""
    e = checkpointed(_edges(edges))
    nodes = e.select("net", F.col("parent").alias("node")).union(e.select("net", "child")).distinct()
    waits = checkpointed(e.groupBy("net", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("left")))
    levels = [checkpointed(nodes.join(waits, ["net", "node"], "left_anti").withColumn("level", F.lit(0)))]
    while not levels[-1].isEmpty():
        freed = e.join(levels[-1].select("net", F.col("node").alias("parent")), ["net", "parent"], "left_semi").groupBy("net", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("__n"))
        waits = checkpointed(waits.where("left > 0").join(freed, ["net", "node"], "left").select("net", "node", (F.col("left") - F.coalesce("__n", F.lit(0))).alias("left")))
        levels.append(checkpointed(waits.where("left = 0").select("net", "node", F.lit(len(levels)).alias("level"))))
    if not waits.where("left > 0").isEmpty():
        raise ValueError("edges form a cycle")
    return reduce(DataFrame.unionByName, levels)
