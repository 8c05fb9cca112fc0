"""Likelihood of gapped columns along a tree, with insertions and deletions as events of their own; sites go through Arrow batches, many at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators import columns
from cladeframe.plans.models import Model, with_gap
from cladeframe.plans.session import checkpointed
from cladeframe.plans.tree import Tree


def deletion(t: Column, mu: float, lam: float) -> Column:
    """The chance that a character is gone after time t; 0 if both rates are 0."""
    return F.lit(0.0) if mu + lam == 0 else mu / (mu + lam) * -F.expm1(-(mu + lam) * t)


def insertion(t: Column, mu: float, lam: float) -> Column:
    """The chance that a gap holds a character after time t; 0 if both rates are 0."""
    return F.lit(0.0) if mu + lam == 0 else lam / (mu + lam) * -F.expm1(-(mu + lam) * t)


def gap_given_character(t: Column, mu: float, lam: float) -> Column:
    """A deletion and no insertion in time t."""
    return (1 - insertion(t, mu, lam)) * deletion(t, mu, lam)


def _inserted(t: np.ndarray, mu: float, lam: float) -> np.ndarray:
    return np.zeros_like(t) if mu + lam == 0 else lam / (mu + lam) * -np.expm1(-(mu + lam) * t)


def _columns(codes: np.ndarray, tree: Tree, model: Model, mu: float, lam: float, stay: float) -> np.ndarray:
    """ln of each column's chance. ``codes``: columns by leaves (as they come in the tree), the letter's number or -1 for a gap."""
    k, n = len(model.freqs), len(tree.labels)
    full = with_gap(model, mu, lam) if mu + lam else None
    freqs = np.array(full.freqs[:k] if full else model.freqs)
    t = np.array(tree.dists)
    came = _inserted(t, mu, lam)
    went = _inserted(t, lam, mu) * (1 - came)  # a deletion and no insertion
    steps = {d: (full or model).transition(d)[:k, :k] for d in set(tree.dists)}
    letters = np.full((n, len(codes), k), -np.inf)  # ln of the chance of what lies below a node with each letter
    gapped = np.full((n, len(codes)), -np.inf)  # and with a gap
    empty = np.ones((n, len(codes)), bool)  # whether all leaves below are gaps
    for j, i in enumerate(i for i in range(n) if not tree.children[i]):
        empty[i] = codes[:, j] < 0
        letters[i][~empty[i], codes[~empty[i], j]] = 0

    def mixed(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        return np.log(np.exp(x - top) @ weights) + (top if weights.ndim == 2 else top[:, 0])

    with np.errstate(divide="ignore"):
        for i in reversed(range(n)):  # parents come first, so a node's children are done
            if tree.children[i]:
                letters[i] = 0
            for c in tree.children[i]:
                lost = np.where(empty[c], np.log(went[c]), -np.inf)[:, None]
                letters[i] += np.logaddexp(mixed(letters[c], steps[tree.dists[c]].T) + np.log1p(-came[c]), lost)
                new = np.logaddexp(np.log(came[i]) + mixed(letters[c], freqs), gapped[c])
                gapped[i] = np.logaddexp(gapped[i], np.where(empty[c], new, -np.inf))
                empty[i] &= empty[c]
        return np.logaddexp(gapped[0], np.log(stay) + mixed(letters[0], freqs))


def _coded(sites: DataFrame, tree: Tree, model: Model) -> DataFrame:
    """site and codes: the leaves' letters as numbers in an array, a gap (null, or no row) as -1. A letter outside the alphabet counts as a gap."""
    tips = tree.leaves
    known = sites.withColumn("state", F.when(F.col("state").isin(*model.alphabet), F.col("state")))

    def run(batches):
        for part in columns.slices(batches, len(tree.labels)):
            codes = columns.coded(part, tree, model.alphabet)[:, tips].astype(np.int32)
            ends = np.arange(len(codes) + 1, dtype=np.int32) * len(tips)
            yield pa.RecordBatch.from_arrays([part.column("site"), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel()))], names=["site", "codes"])

    return columns.gathered(known).mapInArrow(run, "site long, codes array<int>")


def column_likelihood(sites: DataFrame, tree: Tree, model: Model, mu: float, lam: float, stay: float) -> DataFrame:
    """site and lp: ln of each column's chance. ``sites``: site, leaf, state (null: gap), of a leaf's repeated rows the last letter; ``mu`` and ``lam``: rates of deletion and insertion;
    ``stay``: the parameter of the geometric length. Below a character, a child has another character (and nothing was inserted) or, if all its leaves are
    gaps, nothing; below a gap, children whose leaves are all gaps count. A column without leaves of the tree is one of gaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"site": b["site"], "lp": _columns(np.stack(b["codes"].to_numpy()), tree, model, mu, lam, stay)})

    return _coded(sites, tree, model).mapInPandas(run, "site long, lp double")


def length_terms(tree: Tree, model: Model, mu: float, lam: float, stay: float) -> float:
    """ln of the extra column (no insertion on any branch, the end of the length), less ln of one minus the chance of a column of gaps."""
    t = np.array([d for d, p in zip(tree.dists, tree.parents) if p >= 0])
    tips = sum(not kids for kids in tree.children)
    none = _columns(np.full((1, tips), -1), tree, model, mu, lam, stay)[0]
    return float(math.log1p(-stay) + np.log1p(-_inserted(t, mu, lam)).sum() - math.log1p(-math.exp(none)))


def alignment_likelihood(sites: DataFrame, tree: Tree, model: Model, mu: float, lam: float, stay: float) -> DataFrame:
    """columns and lp of the whole alignment: its columns' sum and the length terms. No columns give the length terms alone."""
    found = column_likelihood(sites, tree, model, mu, lam, stay).agg(F.count("lp").alias("columns"), F.coalesce(F.sum("lp"), F.lit(0.0)).alias("lp"))
    return found.withColumn("lp", F.col("lp") + length_terms(tree, model, mu, lam, stay))


def fit_indel_rate(sites: DataFrame, tree: Tree, model: Model, stay: float, low: float = 1e-4, high: float = 2.0, tolerance: float = 1e-4) -> float:
    """The rate, of deletions and of insertions alike, of highest likelihood between two bounds, by golden sections. Columns alike are counted once, before
    the search; each step is one sum over them."""
    kinds = checkpointed(_coded(sites, tree, model).groupBy("codes").agg(F.count(F.lit(1)).alias("n")))

    def value(rate: float) -> float:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"v": [float((_columns(np.stack(b["codes"].to_numpy()), tree, model, rate, rate, stay) * b["n"]).sum())]})

        return (kinds.mapInPandas(run, "v double").agg(F.sum("v")).first()[0] or 0.0) + length_terms(tree, model, rate, rate, stay)

    share = (math.sqrt(5) - 1) / 2
    a, b = high - share * (high - low), low + share * (high - low)
    at_a, at_b = value(a), value(b)
    while high - low > tolerance:
        if at_a >= at_b:
            high, b, at_b = b, a, at_a
            a = high - share * (high - low)
            at_a = value(a)
        else:
            low, a, at_a = a, b, at_b
            b = low + share * (high - low)
            at_b = value(b)
    return (low + high) / 2
