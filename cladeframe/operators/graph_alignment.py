"""Sequences aligned onto partial-order graphs, and the graph's next version with them threaded in.

A cell of the program is a node of the graph and a number of symbols taken; it has as many predecessors as the node has. Nodes are visited in topological order and all numbers
of symbols at once, so a node costs a few array operations. Pairs of a graph and a sequence are dealt to tasks by what they cost, nodes times symbols;
a pair's table is that large and lives in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.operators.scans import scanned
from cladeframe.plans.session import checkpointed

#: Cells of all pairs of a task, about.
TASK_CELLS = 20_000_000
_WAYS = "graph string, text string, score double, way array<struct<pos:long,sym:string>>"
_TIE = 1e-9


def gathered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, n_nodes, nodes (pos, sym, n) and links (from_pos, to_pos) of each graph, a row each."""
    n = nodes.where("pos IS NOT NULL AND sym IS NOT NULL").groupBy(F.col("graph").cast("string").alias("graph")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "sym", F.col("n").cast("double").alias("n")))).alias("nodes"), F.countDistinct("pos").alias("n_nodes"))
    e = edges.groupBy(F.col("graph").cast("string").alias("graph")).agg(F.sort_array(F.collect_set(F.struct(F.col("from_pos").cast("long").alias("from_pos"), F.col("to_pos").cast("long").alias("to_pos")))).alias("links"))
    return n.join(e, "graph")


def dealt(pairs: DataFrame) -> DataFrame:
    """Pairs with ``task``: runs of pairs, in order of graph and sequence, that cost about TASK_CELLS together. ``pairs``: graph, seq, text, n_nodes."""
    cost = ((F.col("n_nodes") + 1) * (F.length("text") + 1)).cast("long")
    ran = scanned(pairs.withColumn("cost", cost).withColumn("all", F.lit(1)), ["all"], ["graph", "seq"], before=("sum", "cost", False))
    return ran.withColumn("task", F.floor(F.col("before") / TASK_CELLS)).drop("all", "before", "cost")


def aligned(nodes: list[tuple[int, dict[str, float]]], links: list[tuple[int, int]], text: str, width: int, pair, gap: float, skip: float, told: dict[str, np.ndarray] | None = None) -> tuple[float, list[tuple[int | None, str | None]]] | None:
    """The best score of a text along any path from -1 to ``width``, and the path: (node, symbol), (None, symbol) for one that no node takes, (node, None) for a node
    that takes none. None if there is no path. ``pair(a, b)``: the score of a node's symbol a and the text's b; a node of several symbols scores their mean by share.
    ``told``: the scores of a symbol on all nodes, by symbol, which are filled in for the graph's other texts. Ties: a symbol on a node before a skipped node before an extra symbol; smaller predecessors first.
    """
    shares = dict(nodes)
    before: dict[int, list[int]] = {}
    ahead: dict[int, list[int]] = {}
    for a, b in links:
        before.setdefault(b, []).append(a)
        ahead.setdefault(a, []).append(b)
    order, left, ready = [], {b: len(a) for b, a in before.items()}, sorted(v for v in ahead if v not in before)
    while ready:
        v = ready.pop()
        order.append(v)
        for w in ahead.get(v, []):
            left[w] -= 1
            if not left[w]:
                ready.append(w)
    size, told, place = len(text), {} if told is None else told, {v: i for i, v in enumerate(shares)}
    for b in set(text) - told.keys():
        told[b] = np.array([sum(n * pair(a, b) for a, n in share.items()) / (sum(share.values()) or 1.0) for share in shares.values()])
    scores = np.array([told[b] for b in text]).reshape(size, len(shares))
    rank = gap * np.arange(size + 1)
    cell: dict[int, np.ndarray] = {-1: rank.copy()}
    gain: dict[int, np.ndarray] = {}
    for v in order:
        known = [p for p in before.get(v, []) if p in cell]
        if not known:
            continue  # the start, and what it doesn't lead to
        come = np.max([cell[p] for p in known], axis=0)
        if v == width:
            cell[v] = come
            continue
        gain[v] = scores[:, place[v]] if v in place else np.zeros(size)
        t = come + skip
        t[1:] = np.maximum(t[1:], come[:-1] + gain[v])
        cell[v] = np.maximum.accumulate(t - rank) + rank
    if width not in cell:
        return None
    score, path = float(cell[width][size]), []
    v, j = min(p for p in before[width] if p in cell and cell[p][size] >= score - _TIE), size
    while v != -1 or j:
        if v == -1:
            j -= 1
            path.append((None, text[j]))
            continue
        here, known = cell[v][j], sorted(p for p in before[v] if p in cell)
        came = next((p for p in known if j and cell[p][j - 1] + gain[v][j - 1] >= here - _TIE), None)
        if came is not None:
            path.append((v, text[j - 1]))
            v, j = came, j - 1
            continue
        came = next((p for p in known if cell[p][j] + skip >= here - _TIE), None)
        if came is not None:
            path.append((v, None))
            v = came
        else:
            j -= 1
            path.append((None, text[j]))
    return score, path[::-1]


def align(nodes: DataFrame, edges: DataFrame, sequences: DataFrame, width: int, matrix: dict[tuple[str, str], float] | None = None, match: float = 2.0, mismatch: float = -1.0, gap: float = -2.0, skip: float = -2.0) -> DataFrame:
    """graph, seq, score, step, pos, sym: each sequence's best way through its graph. A step has a node's position and the symbol on it; pos is null for a symbol
    beside the graph, sym for a node that is passed by.

    ``nodes``: graph, pos, sym, n (how often the symbol is there); ``edges``: graph, from_pos, to_pos, from -1 to ``width``, without cycles; ``sequences``: graph, seq, text. ``matrix``: scores of
    pairs of symbols, else ``match`` and ``mismatch``. Sequences with a null text, or whose graph isn't there or has no path, have no rows; an empty text
    passes nodes by. Repeated rows count once, and sequences of one graph with the same text are aligned once.
    """
    pair = (lambda a, b: matrix.get((a, b), mismatch)) if matrix is not None else (lambda a, b: match if a == b else mismatch)
    g = checkpointed(gathered(nodes, edges))
    seqs = sequences.where("text IS NOT NULL").select(F.col("graph").cast("string").alias("graph"), F.col("seq").cast("string").alias("seq"), "text").distinct()
    texts = seqs.select("graph", F.col("text").alias("seq"), "text").distinct()
    pairs = dealt(texts.join(g.select("graph", "n_nodes"), "graph"))
    tasks = max(1, (pairs.agg(F.max("task")).first()[0] or 0) + 1)
    # Texts of a task are few graphs' (they are in order of graph), so a graph travels to a task or two more than it is large.
    met = pairs.repartition(tasks, "task").join(g.select("graph", "nodes", "links"), "graph")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            read: dict[str, tuple] = {}
            for i, (graph, text) in enumerate(zip(batch.column("graph").to_pylist(), batch.column("text").to_pylist())):
                if graph not in read:
                    share: dict[int, dict[str, float]] = {}
                    for x in batch.column("nodes")[i].as_py():
                        share.setdefault(x["pos"], {})[x["sym"]] = x["n"]
                    read[graph] = (list(share.items()), [(x["from_pos"], x["to_pos"]) for x in batch.column("links")[i].as_py()], {})
                *sides, told = read[graph]
                found = aligned(*sides, text, width, pair, gap, skip, told)
                if found is not None:
                    score, path = found
                    out.append((graph, text, score, [{"pos": p, "sym": s} for p, s in path] or [{"pos": None, "sym": None}]))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("pos", pa.int64()), ("sym", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["graph", "text", "score", "way"])

    found = met.select("graph", "text", "nodes", "links").mapInArrow(run, _WAYS)
    steps = seqs.join(found, ["graph", "text"]).select("graph", "seq", "score", F.posexplode("way").alias("step", "at"))
    return steps.select("graph", "seq", "score", "step", "at.pos", "at.sym")


def threaded(steps: DataFrame, nodes: DataFrame, edges: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The graphs' next version: nodes (graph, node, sym, n) and edges (graph, from_node, to_node, n). A symbol on a node counts there; one beside the graph
    becomes a node of its own, named after its sequence and its step. Nodes of the old graph are named by their positions; the ends are -1 and ``width``.
    ``edges``: with n, how often each was gone already."""
    own = F.coalesce(F.col("pos").cast("string"), F.concat("seq", F.lit(":"), F.col("step").cast("string")))
    taken = steps.where("sym IS NOT NULL").withColumn("node", own)
    old = nodes.where("pos IS NOT NULL AND sym IS NOT NULL").select(F.col("graph").cast("string").alias("graph"), F.col("pos").cast("string").alias("node"), "sym", F.col("n").cast("long").alias("n"))
    new_nodes = old.unionByName(taken.select("graph", "node", "sym", F.lit(1).cast("long").alias("n"))).groupBy("graph", "node", "sym").agg(F.sum("n").alias("n"))
    w = W.partitionBy("graph", "seq").orderBy("step")
    ahead = taken.select("graph", "seq", F.col("node").alias("from_node"), F.coalesce(F.lead("node").over(w), F.lit(str(width))).alias("to_node"), F.row_number().over(w).alias("i"))
    first = ahead.where("i = 1").select("graph", F.lit("-1").alias("from_node"), F.col("from_node").alias("to_node"))
    gone = ahead.select("graph", "from_node", "to_node").unionByName(first).withColumn("n", F.lit(1).cast("long"))
    was = edges.select(F.col("graph").cast("string").alias("graph"), F.col("from_pos").cast("string").alias("from_node"), F.col("to_pos").cast("string").alias("to_node"), F.col("n").cast("long").alias("n"))
    return new_nodes, was.unionByName(gone).groupBy("graph", "from_node", "to_node").agg(F.sum("n").alias("n"))
