"""Annotating a tree: hidden states evolve along the branches, and each state emits Gaussian values at the leaves.

The emissions are shared by all sites. A site's values travel as one row, so the dynamic program runs over many sites at once
in NumPy, and a round of learning is one map with partial sums and one grouped sum of a few numbers a state.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.plans.models import Model
from cladeframe.plans.tree import Tree

#: Numbers held at once by the dynamic program (sites x nodes x states); batches are cut to that.
CELLS = 1 << 20


def _by_site(values: DataFrame) -> DataFrame:
    """site and ``seen``: its leaves' values, at most one row a leaf and measurement."""
    return values.groupBy(F.col("site").cast("long").alias("site")).agg(F.collect_list(F.struct(F.col("leaf").alias("leaf"), F.col("value").cast("double").alias("value"))).alias("seen"))


def _dense(seen: pa.ListArray, index: dict[str, int], n: int) -> np.ndarray:
    """(sites, nodes): the mean of each leaf's values, NaN where there is none."""
    flat = seen.flatten()
    site = np.repeat(np.arange(len(seen)), np.diff(seen.offsets.to_numpy()))
    node = pd.Series(flat.field("leaf").to_pandas()).map(index).to_numpy(float)
    value = flat.field("value").to_numpy(zero_copy_only=False).astype(float)
    ok = np.isfinite(value) & ~np.isnan(node)
    total, count = np.zeros((len(seen), n)), np.zeros((len(seen), n))
    np.add.at(total, (site[ok], node[ok].astype(int)), value[ok])
    np.add.at(count, (site[ok], node[ok].astype(int)), 1)
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def _passes(x: np.ndarray, tree: Tree, steps: list[np.ndarray], freqs: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior (node, site, state) and log-likelihood (site): messages up from the leaves, then down."""
    sites, n = x.shape
    up, message = np.ones((n, sites, len(freqs))), np.ones((n, sites, len(freqs)))
    loglik = np.zeros(sites)
    for i in range(n):
        there = ~np.isnan(x[:, i])
        if there.any():
            log = -((x[there, i, None] - means) ** 2) / (2 * variances) - 0.5 * np.log(2 * math.pi * variances)
            top = log.max(axis=1)
            up[i, there] = np.exp(log - top[:, None])
            loglik[there] += top
    for i in reversed(range(1, n)):
        message[i] = np.maximum(up[i] @ steps[i].T, 1e-300)
        above = up[tree.parents[i]]
        above *= message[i]
        top = above.max(axis=1)
        above /= top[:, None]
        loglik += np.log(top)
    down = np.empty_like(up)
    down[0] = freqs
    loglik += np.log((down[0] * up[0]).sum(axis=1))
    for i in range(1, n):
        p = tree.parents[i]
        rest = down[p] * up[p] / message[i]
        down[i] = (rest / rest.sum(axis=1, keepdims=True)) @ steps[i]
    post = down * up
    return post / post.sum(axis=2, keepdims=True), loglik


def _sliced(batches, n: int, k: int):
    for batch in batches:
        size = max(1, CELLS // (n * k))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def fit_emissions(values: DataFrame, tree: Tree, model: Model, rounds: int = 50, tolerance: float = 1e-6, floor: float = 1e-3, rate: float = 1.0) -> tuple[list[float], list[float], float]:
    """Means, variances and log-likelihood of the states' emissions by EM; the model's rates stay as they are.

    ``values``: site, leaf (label), value (null or not finite: missing). A leaf's repeated values count as their mean; leaves that the tree lacks don't count.
    Begins with means at the approximate quantiles, in the order of the alphabet. Without any value the means are 0 and the variances ``floor``.
    """
    n, k, index = len(tree.labels), len(model.alphabet), {lab: i for i, lab in enumerate(tree.labels)}
    known = values.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & F.col("leaf").isNotNull() & (F.abs(F.col("value").cast("double")) < float("inf")))
    first = known.agg(F.percentile_approx(F.col("value").cast("double"), [(i + 0.5) / k for i in range(k)], 10_000), F.var_pop("value"), F.count("value")).first()
    if not first[2]:
        return [0.0] * k, [floor] * k, 0.0
    m, v, was = np.array(first[0], float), np.full(k, max(floor, first[1])), -math.inf
    steps, freqs = [model.transition(d * rate) for d in tree.dists], np.array(model.freqs)
    sites = _by_site(known).persist()
    try:
        for _ in range(rounds):

            def sums(batches, m=m, v=v):
                total = np.zeros((k + 1, 3))
                for batch in _sliced(batches, n, k):
                    x = _dense(batch.column("seen"), index, n)
                    post, loglik = _passes(x, tree, steps, freqs, m, v)
                    r = np.where(np.isnan(x.T)[:, :, None], 0, post)
                    y = np.nan_to_num(x.T)[:, :, None]
                    total[:k] += np.stack([r.sum(axis=(0, 1)), (r * y).sum(axis=(0, 1)), (r * y * y).sum(axis=(0, 1))], axis=1)
                    total[k, 0] += loglik.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), *(pa.array(c) for c in total.T)], names=["k", "n", "x", "xx"])

            got = sites.mapInArrow(sums, "k long, n double, x double, xx double").groupBy("k").agg(F.sum("n"), F.sum("x"), F.sum("xx")).orderBy("k").collect()  # one row a state
            s = np.array([r[1:] for r in got], float)
            loglik, s = float(s[k, 0]), s[:k]
            m = np.where(s[:, 0] > 1e-12, s[:, 1] / np.maximum(s[:, 0], 1e-12), m)
            v = np.maximum(floor, np.where(s[:, 0] > 1e-12, s[:, 2] / np.maximum(s[:, 0], 1e-12) - m**2, v))
            if abs(loglik - was) <= tolerance * abs(loglik):
                break
            was = loglik
    finally:
        sites.unpersist()
    return m.tolist(), v.tolist(), loglik


def annotated(values: DataFrame, tree: Tree, model: Model, means: list[float], variances: list[float], weight: float = 1.0, rate: float = 1.0) -> DataFrame:
    """site, node, state, p, mean, sd, upper: for every node its most probable hidden state (ties to the earlier one of the alphabet), and the predicted
    value's mean, standard deviation and upper bound, mean + ``weight`` * sd. A site whose values are all missing gets the model's prior."""
    n, k, index = len(tree.labels), len(model.alphabet), {lab: i for i, lab in enumerate(tree.labels)}
    steps, freqs, m, v = [model.transition(d * rate) for d in tree.dists], np.array(model.freqs), np.array(means), np.array(variances)

    def run(batches):
        for batch in _sliced(batches, n, k):
            post, _ = _passes(_dense(batch.column("seen"), index, n), tree, steps, freqs, m, v)
            best = post.argmax(axis=2)
            mean = post @ m
            sd = np.sqrt(np.maximum(0, post @ (v + m * m) - mean**2))
            site = np.tile(batch.column("site").to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(site), pa.array(np.repeat(np.array(tree.labels, object), batch.num_rows), pa.string()), pa.array(np.array(model.alphabet, object)[best.ravel()], pa.string()), *(pa.array(c.ravel()) for c in (post.max(axis=2), mean, sd, mean + weight * sd))],
                names=["site", "node", "state", "p", "mean", "sd", "upper"],
            )

    return _by_site(values).where("site IS NOT NULL").mapInArrow(run, "site long, node string, state string, p double, mean double, sd double, upper double")
