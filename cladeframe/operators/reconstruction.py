"""Ancestral states: parsimony and likelihood along a tree, site by site.

Sites are the unit of work: rows (site, leaf, state) become one row a site, and batches of them go through dynamic programs over the tree that visit its
nodes once for all sites of a batch (:mod:`cladeframe.operators.columns`). The tree travels with the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.operators import columns
from cladeframe.plans.models import Model
from cladeframe.plans.tree import Tree


def _inner(tree: Tree) -> list[int]:
    return [i for i, c in enumerate(tree.children) if c]


def _named(states: np.ndarray, names: list[list[str]]) -> np.ndarray:
    """(sites, nodes): the text of states numbered within their sites."""
    table = np.full((len(names), max(1, max(map(len, names), default=0))), None, object)
    for i, x in enumerate(names):
        table[i, : len(x)] = x
    return np.take_along_axis(table, states, axis=1)


def parsimony(sites: DataFrame, tree: Tree, default: str | None = None) -> DataFrame:
    """site, node (label), state, score: every state that a node has in some most parsimonious assignment, and the site's changes.

    ``sites``: site, leaf (label), state (string; null: unknown). Leaves without a row have the state ``default``, or are unknown. Sites
    without any state have no rows.
    """
    n, labels = len(tree.labels), np.array(tree.labels, object)

    def run(batches):
        for part in columns.slices(batches, n):
            codes, every = columns.own_states(part, tree, default)
            for told in columns.parts(every, n):
                names = [every[i] for i in told]
                best, score = columns.most_parsimonious(codes[told], tree, columns.used_states(names))
                i, s, k = np.nonzero(best)
                state = _named(np.tile(np.arange(best.shape[2]), (len(names), 1)), names)
                yield pa.RecordBatch.from_arrays([part.column("site").take(pa.array(told[s])), pa.array(labels[i], pa.string()), pa.array(state[s, k], pa.string()), pa.array(score[s].astype(np.int32))], names=["site", "node", "state", "score"])

    return columns.gathered(sites).mapInArrow(run, "site long, node string, state string, score int")


def joint(sites: DataFrame, tree: Tree, model: Model, rate: float = 1.0, default: str | None = None) -> DataFrame:
    """site, node, state, log_likelihood: the jointly most probable states of the inner nodes, by max-product; ties (to nine digits) to the earlier
    state of the alphabet. States outside the alphabet count as unknown. Leaves without a row have the state ``default``, or are unknown."""
    steps, start = _log_steps(tree, model, rate)
    inner, letters, n, k = _inner(tree), np.array(model.alphabet, object), len(tree.labels), len(model.alphabet)

    def run(batches):
        for part in columns.slices(batches, n * k):
            codes = columns.coded(part, tree, model.alphabet)
            if default is not None:
                codes = columns.with_default(codes, part, tree, model.alphabet.index(default))
            state, total = columns.most_probable(codes, tree, steps, start)
            yield columns.rows(part, tree, inner, letters[state], total, pa.float64(), "log_likelihood")

    return columns.gathered(sites).mapInArrow(run, "site long, node string, state string, log_likelihood double")


def _log_steps(tree: Tree, model: Model, rate: float) -> tuple[list[np.ndarray], np.ndarray]:
    by_time = {d: np.log(np.maximum(model.transition(d * rate), 1e-300)) for d in set(tree.dists)}
    return [by_time[d] for d in tree.dists], np.log(np.maximum(model.freqs, 1e-300))


def marginal(sites: DataFrame, tree: Tree, model: Model, node: str, rate: float = 1.0) -> DataFrame:
    """site, state, p, log_likelihood: the posterior of one node's states, by sum-product from the leaves up and back down to the node."""
    at, by_time, n, k = tree.labels.index(node), {d: model.transition(d * rate) for d in set(tree.dists)}, len(tree.labels), len(model.alphabet)
    steps, letters = [by_time[d] for d in tree.dists], np.array(model.alphabet, object)

    def run(batches):
        for part in columns.slices(batches, n * k):
            p, total = columns.posterior(columns.coded(part, tree, model.alphabet), tree, steps, np.array(model.freqs), at)
            site = part.column("site").take(pa.array(np.repeat(np.arange(len(p)), k)))
            yield pa.RecordBatch.from_arrays([site, pa.array(np.tile(letters, len(p)), pa.string()), pa.array(p.ravel()), pa.array(np.repeat(total, k))], names=["site", "state", "p", "log_likelihood"])

    return columns.gathered(sites).mapInArrow(run, "site long, state string, p double, log_likelihood double")


# --- indels

def jumps(alignment: DataFrame, width: int) -> DataFrame:
    """leaf, from_pos, to_pos of each gapped sequence: from -1 to its first character, between neighbours, from its last to ``width``.
    ``alignment``: leaf, pos, sym (null: gap)."""
    there = alignment.where("sym IS NOT NULL").select("leaf", "pos")
    w = W.partitionBy("leaf").orderBy("pos")
    ahead = there.select("leaf", F.col("pos").alias("from_pos"), F.coalesce(F.lead("pos").over(w), F.lit(width)).alias("to_pos"))
    first = there.groupBy("leaf").agg(F.min("pos").alias("to_pos")).select("leaf", F.lit(-1).cast("long").alias("from_pos"), "to_pos")
    return first.unionByName(ahead.select("leaf", F.col("from_pos").cast("long").alias("from_pos"), "to_pos"))


def bidirectional_edge_parsimony(alignment: DataFrame, tree: Tree, width: int) -> DataFrame:
    """node, from_pos, to_pos, recip: the edges of each ancestor's graph. For every position the next (and previous) occupied one is a
    state of the leaves; ancestors get all most parsimonious ones. Edges that both directions have are reciprocated."""
    j = jumps(alignment, width)
    forward = j.select((F.col("from_pos") * 2 + 2).alias("site"), "leaf", F.col("to_pos").cast("string").alias("state"))
    backward = j.select((F.col("to_pos") * 2 + 3).alias("site"), "leaf", F.col("from_pos").cast("string").alias("state"))
    inner = [lab for lab, c in zip(tree.labels, tree.children) if c]
    found = parsimony(forward.unionByName(backward), tree).where(F.col("node").isin(inner))
    ahead = F.col("site") % 2 == 0
    here, there = F.when(ahead, (F.col("site") - 2) / 2).otherwise((F.col("site") - 3) / 2).cast("long"), F.col("state").cast("long")
    edges = found.select("node", F.when(ahead, here).otherwise(there).alias("from_pos"), F.when(ahead, there).otherwise(here).alias("to_pos"), ahead.alias("f"))
    return edges.groupBy("node", "from_pos", "to_pos").agg((F.bool_or("f") & F.bool_or(~F.col("f"))).alias("recip"))


def presence_by_parsimony(alignment: DataFrame, tree: Tree) -> DataFrame:
    """site, node, state ("1" or "0"), score: position-specific parsimony of character against gap."""
    return parsimony(alignment.select(F.col("pos").alias("site"), "leaf", F.col("sym").isNotNull().cast("int").cast("string").alias("state")), tree)


def presence_by_likelihood(alignment: DataFrame, tree: Tree, rate: float = 1.0) -> DataFrame:
    """The same by joint likelihood under equal rates of gain and loss."""
    from cladeframe.plans.models import jc

    return joint(alignment.select(F.col("pos").alias("site"), "leaf", F.col("sym").isNotNull().cast("int").cast("string").alias("state")), tree, jc(("1", "0")), rate)


def gap_statistics(alignment: DataFrame) -> DataFrame:
    """One row: gaps, gap_starts (runs of gaps), mean_gap_length (null without gaps), occupancy and the average length, truncated (null without rows)."""
    w = W.partitionBy("leaf").orderBy("pos")
    x = alignment.withColumn("start", (F.col("sym").isNull() & F.coalesce(F.lag("sym").over(w).isNotNull() | F.lag("pos").over(w).isNull(), F.lit(True))).cast("int"))
    s = x.agg(F.count_if(F.col("sym").isNull()).alias("gaps"), F.sum("start").alias("gap_starts"), F.count(F.lit(1)).alias("cells"), F.countDistinct("pos").alias("width"))
    return s.select("gaps", "gap_starts", F.try_divide("gaps", "gap_starts").alias("mean_gap_length"), (1 - F.try_divide("gaps", "cells")).alias("occupancy"), ((1 - F.try_divide("gaps", "cells")) * F.col("width")).cast("int").alias("average_length"))


def indel_events(presence: DataFrame, tree: DataFrame) -> DataFrame:
    """node, events: on each branch, the maximal runs of one non-zero difference in presence to the parent. ``presence``: node, pos, p (0 or 1); ``tree``: node, parent."""
    above = presence.select(F.col("node").alias("parent"), "pos", F.col("p").alias("q"))
    d = presence.join(tree.select("node", "parent"), "node").join(above, ["parent", "pos"]).withColumn("d", F.col("p") - F.col("q"))
    w = W.partitionBy("node").orderBy("pos")
    return d.withColumn("was", F.coalesce(F.lag("d").over(w), F.lit(0))).groupBy("node").agg(F.count_if((F.col("d") != 0) & (F.col("d") != F.col("was"))).alias("events"))


def joint_recoded(sites: DataFrame, tree: Tree, rate: float = 1.0) -> DataFrame:
    """As :func:`joint`, each site under equal rates between the states that its leaves show (in order); sites without any have no rows."""
    times, inner, n = np.array(tree.dists) * rate, _inner(tree), len(tree.labels)

    def run(batches):
        for part in columns.slices(batches, n):
            codes, every = columns.own_states(part, tree)
            for told in columns.parts(every, n):
                names = [every[i] for i in told]
                state, total = columns.most_probable_recoded(codes[told], tree, times, columns.used_states(names))
                yield columns.rows(part.take(pa.array(told)), tree, inner, _named(state, names), total, pa.float64(), "log_likelihood")

    return columns.gathered(sites).mapInArrow(run, "site long, node string, state string, log_likelihood double")


def bidirectional_edge_likelihood(alignment: DataFrame, tree: Tree, width: int, rate: float = 1.0) -> DataFrame:
    """As :func:`bidirectional_edge_parsimony`, with the jointly most probable jumps of every position instead of the most parsimonious."""
    j = jumps(alignment, width)
    forward = j.select((F.col("from_pos") * 2 + 2).alias("site"), "leaf", F.col("to_pos").cast("string").alias("state"))
    backward = j.select((F.col("to_pos") * 2 + 3).alias("site"), "leaf", F.col("from_pos").cast("string").alias("state"))
    found = joint_recoded(forward.unionByName(backward), tree, rate)
    ahead = F.col("site") % 2 == 0
    here, there = F.when(ahead, (F.col("site") - 2) / 2).otherwise((F.col("site") - 3) / 2).cast("long"), F.col("state").cast("long")
    edges = found.select("node", F.when(ahead, here).otherwise(there).alias("from_pos"), F.when(ahead, there).otherwise(here).alias("to_pos"), ahead.alias("f"))
    return edges.groupBy("node", "from_pos", "to_pos").agg((F.bool_or("f") & F.bool_or(~F.col("f"))).alias("recip"))


def indel_lengths(presence: DataFrame, tree: DataFrame) -> DataFrame:
    """kind (insertion or deletion), length, n: runs of positions that a branch gains or loses. ``presence``: node, pos, p; ``tree``: node, parent.
    Runs that reach the last position count too."""
    above = presence.select(F.col("node").alias("parent"), "pos", F.col("p").alias("q"))
    d = presence.join(tree.select("node", "parent"), "node").join(above, ["parent", "pos"]).withColumn("d", F.col("p") - F.col("q"))
    w = W.partitionBy("node").orderBy("pos")
    runs = d.withColumn("new", (F.coalesce(F.lag("d").over(w), F.lit(0)) != F.col("d")).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    lengths = runs.where("d <> 0").groupBy("node", "run", "d").agg(F.count(F.lit(1)).alias("length"))
    return lengths.groupBy(F.when(F.col("d") > 0, "insertion").otherwise("deletion").alias("kind"), "length").agg(F.count(F.lit(1)).alias("n"))


def simulated(spark, tree: Tree, model: Model, n_sites: int, seed: int = 0, rate: float = 1.0) -> DataFrame:
    """site, node, state of every node at ``n_sites`` sites drawn from the model along the tree. A site's draws come from its own number
    and the seed, so a repeated task gives the same ones."""
    steps = {d: np.cumsum(model.transition(d * rate), axis=1) for d in set(tree.dists)}
    start, alphabet = np.cumsum(model.freqs), np.array(model.alphabet)

    def run(batches):
        for batch in batches:
            out = []
            for site in batch["id"]:
                u = np.random.default_rng([seed, int(site)]).random(len(tree.labels))
                state = np.zeros(len(tree.labels), int)
                state[0] = min(len(start) - 1, np.searchsorted(start, u[0] * start[-1], "right"))
                for i in range(1, len(state)):
                    row = steps[tree.dists[i]][state[tree.parents[i]]]
                    state[i] = min(len(row) - 1, np.searchsorted(row, u[i] * row[-1], "right"))
                out.append(pd.DataFrame({"site": site, "node": tree.labels, "state": alphabet[state]}))
            if out:
                yield pd.concat(out)

    return spark.range(n_sites).mapInPandas(run, "site long, node string, state string")


def rate_segments(scores: DataFrame, max_length: int, penalty: float) -> DataFrame:
    """aln_id, start, stop (inclusive), category: the best partition of each alignment's positions into segments of one rate category.
    ``scores``: aln_id, pos (from 0, without holes), ll (array of log-likelihoods by category). A segment costs ``penalty`` and is at most
    ``max_length`` long; prefix sums make each candidate one subtraction. An alignment's positions are one group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        sums = np.concatenate([np.zeros((1, len(g["ll"].iloc[0]))), np.cumsum(np.stack(g["ll"].to_numpy()), axis=0)])
        n = len(g)
        best, back = np.full(n + 1, -np.inf), np.zeros((n + 1, 2), int)
        best[0] = 0
        for stop in range(1, n + 1):
            first = max(0, stop - max_length)
            total = best[first:stop, None] + sums[stop] - sums[first:stop] - penalty
            at, c = np.unravel_index(total.argmax(), total.shape)
            best[stop], back[stop] = total[at, c], (first + at, c)
        out, stop = [], n
        while stop:
            first, c = back[stop]
            out.append((g["aln_id"].iloc[0], int(first), int(stop - 1), int(c)))
            stop = first
        return pd.DataFrame(out[::-1], columns=["aln_id", "start", "stop", "category"])

    return scores.select("aln_id", "pos", "ll").groupBy("aln_id").applyInPandas(run, "aln_id string, start long, stop long, category int")


def gap_intervals(alignment: DataFrame) -> DataFrame:
    """leaf, lo, hi: the maximal runs of gaps of each sequence."""
    w = W.partitionBy("leaf").orderBy("pos")
    runs = alignment.where("sym IS NULL").select("leaf", "pos").withColumn("run", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("leaf", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).drop("run")


def simple_indel_coding(alignment: DataFrame, bin_width: int = 64) -> DataFrame:
    """leaf, lo, hi, state: one character for each distinct gap interval. A sequence that has the very gap is "1"; one whose gap
    contains it and more is unknown (null); all others, "0", have no row, so the table is as large as the gaps and not as leaves times characters."""
    from cladeframe.operators.intervals import overlap_join

    gaps = gap_intervals(alignment)
    characters = gaps.select("lo", "hi").distinct()
    inside = overlap_join(characters, gaps, bin_width).where("b_lo <= lo AND hi <= b_hi")
    same = (F.col("lo") == F.col("b_lo")) & (F.col("hi") == F.col("b_hi"))
    return inside.select(F.col("b_leaf").alias("leaf"), "lo", "hi", F.when(same, "1").alias("state"))


def indel_coding_parsimony(alignment: DataFrame, tree: Tree, width: int) -> DataFrame:
    """lo, hi, node, state ("1": the gap is there), score: most parsimonious states of every indel character at every node."""
    coded = simple_indel_coding(alignment).select((F.col("lo") * (width + 1) + F.col("hi")).alias("site"), "leaf", "state")
    p = parsimony(coded, tree, default="0")
    return p.select(F.floor(F.col("site") / (width + 1)).alias("lo"), (F.col("site") % (width + 1)).alias("hi"), "node", "state", "score")


def indel_coding_likelihood(alignment: DataFrame, tree: Tree, width: int, rate: float = 1.0) -> DataFrame:
    """lo, hi, node, state ("1": the gap is there), log_likelihood: jointly most probable states of every indel character at the inner nodes, under equal rates of gain and loss."""
    from cladeframe.plans.models import jc

    coded = simple_indel_coding(alignment).select((F.col("lo") * (width + 1) + F.col("hi")).alias("site"), "leaf", "state")
    p = joint(coded, tree, jc(("0", "1")), rate, default="0")
    return p.select(F.floor(F.col("site") / (width + 1)).alias("lo"), (F.col("site") % (width + 1)).alias("hi"), "node", "state", "log_likelihood")
