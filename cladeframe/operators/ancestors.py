"""Ancestral sequences end to end: which positions each ancestor has, a tree for every position, states along it, and the preferred path through each
ancestor's graph, read as a sequence.

A position's tree is the alignment's tree cut down to the nodes that have the position. It falls apart where an ancestor lacks it; each part is a tree of its own,
and parts without a sequence below (orphans) tell nothing and go. Trees are rows by position; states go through batches of positions with a mask each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.operators import columns, graphs, reconstruction
from cladeframe.plans.models import Model
from cladeframe.plans.session import checkpointed
from cladeframe.plans.tree import Tree


def _inner(tree: Tree) -> list[str]:
    return [lab for lab, c in zip(tree.labels, tree.children) if c]


def leaves_below(spark, tree: Tree) -> DataFrame:
    """node and leaf: each inner node and the leaves below it (as many rows as leaves times their depths)."""
    rows = []
    for i in tree.leaves:
        at = tree.parents[i]
        while at >= 0:
            rows.append((tree.labels[at], tree.labels[i]))
            at = tree.parents[at]
    return spark.createDataFrame(rows, "node string, leaf string")


def occupied(alignment: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """site and node: the positions that each node has. A sequence has those with a character, an ancestor those on a path from end to end of its graph
    (``edges``: node, from_pos, to_pos)."""
    return _occupied(alignment, graphs.nibbled(edges.select(F.col("node").alias("graph"), "from_pos", "to_pos"), width), width)


def _occupied(alignment: DataFrame, whole: DataFrame, width: int) -> DataFrame:
    inside = whole.select(F.col("graph").alias("node"), F.explode(F.array("from_pos", "to_pos")).alias("site")).where(F.col("site").between(0, width - 1)).distinct()
    own = alignment.where("sym IS NOT NULL").select(F.col("leaf").alias("node"), F.col("pos").cast("long").alias("site")).distinct()
    return own.select("site", "node").unionByName(inside.select("site", "node"))


def _by_site(present: DataFrame) -> DataFrame:
    return present.where("site IS NOT NULL").groupBy(F.col("site").cast("long").alias("site")).agg(F.collect_set(F.col("node").cast("string")).alias("nodes"))


def _mask(part: pa.RecordBatch, tree: Tree) -> np.ndarray:
    """(sites, nodes): whether a node is among the site's ``nodes``."""
    nodes = part.column("nodes")
    owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(nodes.offsets)))
    place = np.asarray(pc.fill_null(pc.index_in(nodes.flatten(), value_set=pa.array(tree.labels, pa.string())), -1), dtype=np.int64)
    present = np.zeros((part.num_rows, len(tree.labels)), bool)
    present[owner[place >= 0], place[place >= 0]] = True
    return present


def position_trees(present: DataFrame, tree: Tree, orphans: bool = False) -> DataFrame:
    """site, node, parent: the tree of every position, of the nodes that are ``present`` (site, node); parent is null for the root of each part. Parts without a
    leaf are left out unless ``orphans``. Labels that the tree lacks don't count."""
    n, labels, kids = len(tree.labels), np.array([*tree.labels, None], object), tree.children

    def run(batches):
        for part in columns.slices(batches, n):
            here = _mask(part, tree)
            parent = np.full(here.shape, n)  # the place after the last node has no label
            fed = here & np.array([not c for c in kids])
            for i in reversed(range(1, n)):
                p = tree.parents[i]
                parent[here[:, i] & here[:, p], i] = p
                fed[:, p] |= fed[:, i] & here[:, p]
            for i in range(1, n):  # what hangs on a node with a leaf below, anywhere in its part, has one too
                p = tree.parents[i]
                fed[:, i] |= here[:, i] & here[:, p] & fed[:, p]
            s, i = np.nonzero(here if orphans else fed)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("site"))[s]), pa.array(labels[i], pa.string()), pa.array(labels[parent[s, i]], pa.string())], names=["site", "node", "parent"])

    return _by_site(present).mapInArrow(run, "site long, node string, parent string")


def joint_states(sites: DataFrame, trees: DataFrame, tree: Tree, model: Model, rate: float = 1.0) -> DataFrame:
    """site, node, state, log_likelihood: the jointly most probable states of the inner nodes that a position's tree has, each part from its own root.
    ``sites``: site, leaf, state; ``trees``: site, node. Ties (to nine digits) to the earlier state of the alphabet; other states count as unknown."""
    steps, start = reconstruction._log_steps(tree, model, rate)
    inner = [i for i, c in enumerate(tree.children) if c]
    letters, n, k = np.array(model.alphabet, object), len(tree.labels), len(model.alphabet)
    rows = _by_site(trees).join(columns.gathered(sites), "site", "left")

    def run(batches):
        for part in columns.slices(batches, n * k):
            present = _mask(part, tree)
            seen = part.column("seen")
            filled = part if not seen.null_count else part.set_column(part.schema.get_field_index("seen"), "seen", pc.if_else(pc.is_valid(seen), seen, pa.scalar([], seen.type)))
            state, total = columns.most_probable(columns.coded(filled, tree, model.alphabet), tree, steps, start, present)
            yield columns.rows(part, tree, inner, letters[state], total, pa.float64(), "log_likelihood", present)

    return rows.select("site", "nodes", "seen").mapInArrow(run, "site long, node string, state string, log_likelihood double")


def supported_edges(alignment: DataFrame, whole: DataFrame, tree: Tree, width: int) -> DataFrame:
    """graph, from_pos, to_pos, recip, weight: the edges of ancestors' graphs (``whole``: graph, from_pos, to_pos, recip), and minus the log of the share that the sequences below it, each
    by its length, give to the edge among those that leave the same position (with a pseudo-count of 1 each); at most 10000."""
    spark = alignment.sparkSession
    below = leaves_below(spark, tree)
    own = reconstruction.jumps(alignment, width)
    length = alignment.where("sym IS NOT NULL").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    total = below.join(length, "leaf").groupBy(F.col("node").alias("graph")).agg(F.sum("n").alias("all"))
    used = own.join(length, "leaf").join(below, "leaf").groupBy(F.col("node").alias("graph"), "from_pos", "to_pos").agg(F.sum("n").alias("n"))
    targets = F.count(F.lit(1)).over(W.partitionBy("graph", "from_pos"))
    x = whole.withColumn("targets", targets).join(used, ["graph", "from_pos", "to_pos"], "left").join(total, "graph", "left")
    rate = (1 + F.coalesce("n", F.lit(0))) / (F.col("targets") + F.coalesce("all", F.lit(0)))
    weight = F.when(F.col("from_pos") < 0, 0.0).otherwise(F.least(-F.log(rate), F.lit(10000.0)))  # the start's edges are free
    return x.select("graph", "from_pos", "to_pos", "recip", weight.alias("weight"))


def sequences(alignment: DataFrame, tree: Tree, model: Model, width: int, rate: float = 1.0, edges: DataFrame | None = None) -> DataFrame:
    """node, sequence, gapped, cost: every ancestor's sequence along its preferred path, without gaps and with "-" at the positions that it leaves out.

    ``alignment``: leaf, pos (0 .. width - 1), sym (null: gap); a symbol is the model's letter and stands in the sequences as it is. ``edges``: node, from_pos, to_pos, recip of ancestors' graphs; if None, those of
    bidirectional edge parsimony. Ancestors without a path from end to end have no row. Symbols outside the alphabet count as unknown, null leaves don't count;
    an alignment without rows gives an empty table.
    """
    alignment = alignment.where("leaf IS NOT NULL")
    edges = checkpointed(reconstruction.bidirectional_edge_parsimony(alignment, tree, width) if edges is None else edges)
    whole = checkpointed(graphs.nibbled(edges.select(F.col("node").alias("graph"), "from_pos", "to_pos", "recip"), width))
    path = graphs.best_paths(supported_edges(alignment, whole, tree, width), width)
    trees = position_trees(_occupied(alignment, whole, width), tree)
    sites = alignment.select(F.col("pos").alias("site"), "leaf", F.col("sym").alias("state"))
    states = joint_states(sites, trees, tree, model, rate)
    on = path.where(F.col("pos").between(0, width - 1)).select(F.col("graph").alias("node"), F.col("pos").alias("site"), "step")
    # A position of the path is in the ancestor's graph, but its part may be an orphan: no sequence tells the state there.
    read = on.join(states.select("site", "node", "state"), ["site", "node"], "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("site", F.coalesce("state", F.lit("?")).alias("state")))).alias("letters"))
    ends = path.where("step = 0").select(F.col("graph").alias("node"), "cost")
    said = F.array_join(F.transform("letters", lambda x: x["state"]), "")
    # Each letter with the gaps before it, then those after the last: a look-up for every position would cost the square of the width.
    gaps = lambda n: F.repeat(F.lit("-"), n.cast("int"))
    passed = F.array_join(F.transform("letters", lambda x, i: F.concat(gaps(x["site"] - F.coalesce(F.get("letters", i - 1)["site"], F.lit(-1)) - 1), x["state"])), "")
    gapped = F.concat(passed, gaps(F.lit(width - 1) - F.element_at("letters", -1)["site"]))
    return ends.join(read, "node", "left").select("node", F.coalesce(said, F.lit("")).alias("sequence"), F.coalesce(gapped, F.lit("-" * width)).alias("gapped"), "cost")


def regained(presence: DataFrame, tree: Tree) -> DataFrame:
    """site and node: where a position is present although it was lost on the way from the root, against the law that what is lost doesn't come back. ``presence``: site, node.
    A position is lost in a lineage from the first node below the root that lacks it; that the root lacks it isn't a loss."""
    n, labels = len(tree.labels), np.array(tree.labels, object)

    def run(batches):
        for part in columns.slices(batches, n):
            here = _mask(part, tree)
            lost = np.zeros(here.shape, bool)
            for i in range(1, n):
                lost[:, i] = lost[:, tree.parents[i]] | ~here[:, i]
            s, i = np.nonzero(lost & here)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("site"))[s]), pa.array(labels[i], pa.string())], names=["site", "node"])

    return _by_site(presence).mapInArrow(run, "site long, node string")


def outside_alignment(edges: DataFrame, alignment: DataFrame, width: int) -> DataFrame:
    """One row: ancestors, outside (those whose graph has an edge that no sequence has), share (null without ancestors). ``edges``: node, from_pos, to_pos."""
    seen = reconstruction.jumps(alignment, width).select("from_pos", "to_pos").distinct()
    new = edges.join(seen, ["from_pos", "to_pos"], "left_anti").select("node").distinct().withColumn("new", F.lit(1))
    counts = edges.select("node").distinct().join(new, "node", "left").agg(F.count(F.lit(1)).alias("ancestors"), F.count("new").alias("outside"))
    return counts.withColumn("share", F.try_divide(F.col("outside"), F.col("ancestors")))
