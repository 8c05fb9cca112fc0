"""Cheapest paths in graphs of any size: rounds that pass only what got cheaper, between blocks of edges.

Edges (graph, from_pos, to_pos, cost >= 0, in any direction) are dealt in blocks of bounded size by where they begin, so one block holds many small graphs
and a large graph lies in many blocks. In a round, each block that got news follows it through its own edges as far as it leads, and what gets cheaper
goes on to the blocks that have edges from there. There are as many rounds as a cheapest path changes blocks, not as it has edges; blocks without news take no part.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.scans import scanned
from cladeframe.plans.session import checkpointed, stored

#: A block has about so many edges.
BLOCK_EDGES = 50_000
#: Up to so many rows of news (32 bytes each) go to every task; more are joined by shuffle.
BROADCAST_NEWS = 500_000
_FOUND = "graph string, pos long, cost double, steps long, by long"


def edge_cost(weight: Column, recip: Column) -> Column:
    """An edge costs its weight, a thousand times that if it isn't reciprocated."""
    return F.when(recip, weight).otherwise(1000 * weight).cast("double")


def blocked(edges: DataFrame) -> DataFrame:
    """graph, from_pos, to_pos, cost (the least of parallel edges) and block. Edges with a null or infinite cost, or a null end, are left out; a negative cost raises ValueError."""
    e = edges.select(F.col("graph").cast("string").alias("graph"), F.col("from_pos").cast("long").alias("from_pos"), F.col("to_pos").cast("long").alias("to_pos"), F.col("cost").cast("double").alias("cost"))
    e = e.where("graph IS NOT NULL AND from_pos IS NOT NULL AND to_pos IS NOT NULL AND cost IS NOT NULL").where(~F.isnan("cost") & (F.col("cost") < float("inf")))
    e = e.groupBy("graph", "from_pos", "to_pos").agg(F.min("cost").alias("cost"))
    size = e.groupBy("graph", "from_pos").agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("least"))
    # Nodes come in order of graph and position, so neighbours in an alignment share a block; a node's edges go by its first one's number.
    before = scanned(size.withColumn("all", F.lit(1)), ["all"], ["graph", "from_pos"], before=("sum", "n", False)).select("graph", "from_pos", "n", "before", "least")
    before = checkpointed(before)
    if (least := before.agg(F.min("least")).first()[0]) is not None and least < 0:
        raise ValueError("an edge costs less than nothing")
    # A hub with more edges than a block has is cut into several; all of them hear of it.
    place = F.pmod(F.xxhash64("to_pos"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_EDGES)))
    return checkpointed(e.join(before.drop("least"), ["graph", "from_pos"]).select("graph", "from_pos", "to_pos", "cost", (F.floor(F.col("before") / BLOCK_EDGES) + place).alias("block")))


def _follow(key, edges: pa.Table, news: pa.Table) -> pa.Table:
    """What a block's edges make of its news: the cheapest way to every node that they lead to, fewest edges first among equals."""
    a, b, cost = (np.asarray(edges.column(c).combine_chunks()) for c in ("from_pos", "to_pos", "cost"))
    graphs = edges.column("graph").combine_chunks().dictionary_encode()
    g = np.asarray(graphs.indices)
    number = {x: i for i, x in enumerate(graphs.dictionary.to_pylist())}
    order = np.lexsort((a, g))
    a, b, cost, g = a[order], b[order], cost[order], g[order]
    first: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (g[1:] != g[:-1])])).tolist() if len(a) else []:
        first[(int(g[i]), int(a[i]))] = i
    ends = np.concatenate([np.flatnonzero((a[1:] != a[:-1]) | (g[1:] != g[:-1])) + 1, [len(a)]]) if len(a) else np.zeros(0, int)
    stop = dict(zip(first.values(), ends.tolist()))
    heap = [(c, s, number[x], p) for x, p, c, s in zip(*(news.column(k).to_pylist() for k in ("g", "p", "c", "s"))) if x in number]
    best = {(x, p): (c, s) for c, s, x, p in sorted(heap, reverse=True)}
    given = dict(best)
    heapq.heapify(heap)
    while heap:
        c, s, x, p = heapq.heappop(heap)
        if (c, s) > best[(x, p)] or (x, p) not in first:
            continue
        i = first[(x, p)]
        for q, w in zip(b[i : stop[i]].tolist(), cost[i : stop[i]].tolist()):
            new = (c + w, s + 1)
            if (x, q) not in best or new < best[(x, q)]:
                best[(x, q)] = new
                heapq.heappush(heap, (*new, x, q))
    found = [(k, v) for k, v in best.items() if given.get(k) != v]
    names = graphs.dictionary.to_pylist()
    return pa.table({"graph": pa.array([names[x] for (x, _), _ in found], pa.string()), "pos": pa.array([p for (_, p), _ in found], pa.int64()), "cost": pa.array([c for _, (c, _) in found], pa.float64()), "steps": pa.array([s for _, (_, s) in found], pa.int64()), "by": pa.array(np.full(len(found), key[0].as_py()), pa.int64())})


def distances(edges: DataFrame, starts: DataFrame, bound: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """graph, pos, cost, steps: the cheapest way from a start to each node that one leads to, and the fewest edges of such ways.

    ``starts``: graph, pos. ``edges``: a table of :func:`blocked`. With ``target`` (graph, pos: one a graph), ways that can't be part of one cheapest to it are
    given up: those that cost more than the cheapest known so far, plus, with ``bound`` (graph, pos, least: what is left from there costs at
    least this), what is left. Costs of nodes that aren't on a cheapest path to the target may then be missing or too high.
    """
    blocks = checkpointed(edges.select("graph", F.col("from_pos").alias("pos"), "block").distinct())
    news = stored(starts.select(F.col("graph").cast("string").alias("graph"), F.col("pos").cast("long").alias("pos")).distinct().withColumns({"cost": F.lit(0.0), "steps": F.lit(0).cast("long"), "by": F.lit(-1).cast("long")}))
    known = news
    while True:
        small = F.broadcast if news.count() <= BROADCAST_NEWS else lambda df: df
        # What a block found out itself it has followed already.
        heard = blocks.join(small(news), ["graph", "pos"]).where("block <> by").select(F.col("block").alias("to_block"), F.col("graph").alias("g"), F.col("pos").alias("p"), F.col("cost").alias("c"), F.col("steps").alias("s"))
        heard = checkpointed(heard)
        if not (n := heard.count()):
            return known.drop("by")
        small = F.broadcast if n <= BROADCAST_NEWS else lambda df: df
        here = edges.join(small(heard.select(F.col("to_block").alias("block")).distinct()), "block", "left_semi")
        made = here.groupBy("block").cogroup(heard.groupBy("to_block")).applyInArrow(_follow, _FOUND)
        made = made.groupBy("graph", "pos").agg(F.min(F.struct("cost", "steps", "by")).alias("new"))
        way = lambda x: F.struct(x["cost"].alias("cost"), x["steps"].alias("steps"))
        old = known.select("graph", "pos", F.struct("cost", "steps").alias("old"))
        both = made.join(old, ["graph", "pos"], "left").where(F.col("old").isNull() | (way(F.col("new")) < F.col("old")))
        if target is not None:
            goal = known.join(target.select("graph", "pos"), ["graph", "pos"], "left_semi").groupBy("graph").agg(F.min("cost").alias("__most"))
            left = F.lit(0.0)
            both = both.join(goal, "graph", "left")
            if bound is not None:
                both = both.join(bound.select("graph", "pos", "least"), ["graph", "pos"], "left")
                left = F.coalesce("least", F.lit(0.0))
            slack = F.col("__most") * 1e-9 + 1e-12  # (sums in another order)
            both = both.where(F.col("__most").isNull() | (F.col("new.cost") + left <= F.col("__most") + slack))
        news = stored(both.select("graph", "pos", "new.cost", "new.steps", "new.by"))
        known = stored(known.join(news.select("graph", "pos"), ["graph", "pos"], "left_anti").unionByName(news))


def turned(edges: DataFrame) -> DataFrame:
    """The edges the other way round."""
    return edges.select("graph", F.col("to_pos").alias("from_pos"), F.col("from_pos").alias("to_pos"), "cost")


def _ends(edges: DataFrame, pos: int) -> DataFrame:
    return edges.select("graph").distinct().withColumn("pos", F.lit(pos).cast("long"))


def connecting(edges: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of ``edges`` (graph, from_pos, to_pos and any others) that lie on a way from ``start`` to ``end``; those with a null graph or end don't."""
    plain = edges.select(F.col("graph").cast("string").alias("graph"), "from_pos", "to_pos", F.lit(1.0).alias("cost"))
    tagged = lambda x, d: x.withColumn("graph", F.concat(F.lit(d), "graph"))
    e = blocked(tagged(plain, "f").unionByName(tagged(turned(plain), "b")))
    found = distances(e, e.select("graph").distinct().withColumn("pos", F.when(F.col("graph").startswith("f"), start).otherwise(end).cast("long")))
    side = lambda d, name: found.where(F.col("graph").startswith(d)).select(F.expr("substring(graph, 2)").alias("graph"), F.col("pos").alias(name))
    keys = edges.select(F.col("graph").cast("string").alias("graph"), F.col("from_pos").cast("long").alias("from_pos"), F.col("to_pos").cast("long").alias("to_pos")).distinct()
    on = keys.join(side("f", "from_pos"), ["graph", "from_pos"], "left_semi").join(side("b", "to_pos"), ["graph", "to_pos"], "left_semi")
    return edges.join(on, ["graph", "from_pos", "to_pos"], "left_semi").select(edges.columns)


def ways(edges: DataFrame, start: int, end: int) -> DataFrame:
    """graph, from_pos, to_pos, cost, before, after, steps_before, steps_after: each edge, the cheapest way from ``start`` to where it begins and from where it ends to
    ``end``, and the fewest edges of any such ways; infinite, and null, where there is none. ``edges``: graph, from_pos, to_pos, cost."""
    # Four searches at once, as graphs of their own: either way, by cost and by number of edges.
    plain = edges.select(F.col("graph").cast("string").alias("graph"), "from_pos", "to_pos", F.col("cost").cast("double").alias("cost"))
    plain = plain.where(F.col("cost").isNotNull() & ~F.isnan("cost") & (F.col("cost") < float("inf")))  # (as blocks leave such edges out)
    sides = [(d, k, (turned(plain) if d == "b" else plain).withColumn("cost", F.lit(1.0) if k == "s" else F.col("cost"))) for d in "fb" for k in "cs"]
    every = reduce(DataFrame.unionByName, (x.withColumn("graph", F.concat(F.lit(f"{d}{k}"), "graph")) for d, k, x in sides))
    e = blocked(every)
    forward = F.substring("graph", 1, 1) == "f"
    found = distances(e, e.select("graph").distinct().withColumn("pos", F.when(forward, start).otherwise(end).cast("long")))
    told = found.select(F.substring("graph", 1, 1).alias("d"), F.substring("graph", 2, 1) == "c", F.expr("substring(graph, 3)").alias("graph"), "pos", "cost").toDF("d", "priced", "graph", "pos", "cost")
    both = told.groupBy("d", "graph", "pos").agg(F.max(F.when(F.col("priced"), F.col("cost"))).alias("far"), F.max(F.when(~F.col("priced"), F.col("cost"))).cast("long").alias("steps"))
    side = lambda d, *names: both.where(F.col("d") == d).select("graph", "pos", "far", "steps").toDF("graph", *names)
    own = e.where(F.col("graph").startswith("fc")).select(F.expr("substring(graph, 3)").alias("graph"), "from_pos", "to_pos", "cost")
    x = own.join(side("f", "from_pos", "before", "steps_before"), ["graph", "from_pos"], "left").join(side("b", "to_pos", "after", "steps_after"), ["graph", "to_pos"], "left")
    none = F.lit(float("inf"))
    return x.select("graph", "from_pos", "to_pos", "cost", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"), "steps_before", "steps_after")


def cheapest(edges: DataFrame, start: int, end: int, bound: DataFrame | None = None) -> DataFrame:
    """graph, step, pos, cost: one cheapest path from ``start`` to ``end`` of every graph that has one, ties (to nine digits) to the smaller predecessor, and what it costs.

    Every node on a cheapest way points to where it comes from; the path is what the pointers lead to from ``end``, gathered by doubling, so in as many
    rounds as the number of its edges has binary digits. ``bound``: see :func:`distances`.
    """
    e = blocked(edges)
    goal = _ends(e, end)
    far = distances(e, _ends(e, start), bound, goal)
    here = far.select("graph", F.col("pos").alias("to_pos"), F.col("cost").alias("__c"), F.col("steps").alias("__s"))
    there = far.select("graph", F.col("pos").alias("from_pos"), F.col("cost").alias("__b"), F.col("steps").alias("__t"))
    least = F.greatest(F.abs("__c"), F.lit(1.0)) * 1e-9
    on = e.join(there, ["graph", "from_pos"]).join(here, ["graph", "to_pos"]).where(F.col("__b") + F.col("cost") <= F.col("__c") + least)
    nearer = (F.col("__b") < F.col("__c") - least) | ((F.col("__b") <= F.col("__c") + least) & (F.col("__t") < F.col("__s")))  # (no way round over edges that cost nothing)
    pointer = stored(on.where(nearer & (F.col("to_pos") != start)).groupBy("graph", "to_pos").agg(F.min("from_pos").alias("up")).withColumnRenamed("to_pos", "pos"))
    path = far.join(goal, ["graph", "pos"]).select("graph", "pos", F.col("cost").alias("__total"), F.lit(0).cast("long").alias("back"))
    path, reach, most = stored(path), 1, pointer.count()
    while True:
        if reach > 2 * most + 2:
            raise ValueError("edges of next to no cost form a cycle")
        more = path.join(pointer, ["graph", "pos"]).select("graph", F.col("up").alias("pos"), "__total", (F.col("back") + reach).alias("back"))
        more = checkpointed(more)
        if more.isEmpty():
            break
        path = stored(path.unionByName(more))
        up = pointer.select("graph", F.col("pos").alias("up"), F.col("up").alias("__up"))
        pointer = stored(pointer.join(up, ["graph", "up"]).select("graph", "pos", F.col("__up").alias("up")))
        reach *= 2
    most = path.groupBy("graph").agg(F.max("back").alias("__most"))
    return path.join(most, "graph").select("graph", (F.col("__most") - F.col("back")).cast("int").alias("step"), "pos", F.col("__total").alias("cost"))
