"""Sampling a network by its Markov blankets: many independent chains as rows, a batch of them moved at once.

A variable's conditional is the product of the tables that it stands in. Variables that share no table have one colour and move together. A chain's draws come from the
seed and its own number, so a task that runs again gives the same samples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.factors import VALUE, variables

#: The tables go to every task: together they may have at most so many cells.
MAX_CELLS = 1_000_000


def coloured(scopes: list[list[str]]) -> list[list[str]]:
    """Groups of variables of which no two share a table, greedily in order of the number of neighbours."""
    near: dict[str, set[str]] = {}
    for s in scopes:
        for v in s:
            near.setdefault(v, set()).update(x for x in s if x != v)
    groups: list[list[str]] = []
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        for g in groups:
            if not near[v] & set(g):
                g.append(v)
                break
        else:
            groups.append([v])
    return groups


def _dense(factors: list[DataFrame], known: dict) -> tuple[list[tuple[list[str], np.ndarray]], dict[str, list]]:
    """The tables as arrays, conditioned on what is known, and the variables' values in order."""
    kept = []
    for f in factors:
        for v, x in known.items():
            if v in f.columns:
                f = f.where(F.col(v) == F.lit(x)).drop(v)
        kept.append(f)
    rows = [(variables(f), f.limit(MAX_CELLS + 1).collect()) for f in kept]
    if sum(len(r) for _, r in rows) > MAX_CELLS:
        raise ValueError(f"tables of more than {MAX_CELLS} cells")
    values: dict[str, list] = {}
    for scope, r in rows:
        for i, v in enumerate(scope):
            values[v] = sorted(set(values.get(v, [])) | {x[i] for x in r})
    if any(math.prod(len(values[v]) for v in scope) > MAX_CELLS for scope, _ in rows):
        raise ValueError(f"tables of more than {MAX_CELLS} cells")
    out = []
    for scope, r in rows:
        a = np.full([len(values[v]) for v in scope], -np.inf)
        for x in r:
            a[tuple(values[v].index(x[i]) for i, v in enumerate(scope))] = x[VALUE]
        out.append((scope, a))
    return [x for x in out if x[0]], values


def samples(spark: SparkSession, factors: list[DataFrame], chains: int, discard: int, keep: int, known: dict | None = None, seed: int = 0, every: int = 1) -> DataFrame:
    """chain, sweep and the variables: ``keep`` samples of each of ``chains`` chains, one of ``every`` sweeps, after ``discard`` sweeps. ``factors``: tables of variables and lp;
    ``known``: values of evidence, which have no column. Chains begin at random values of any chance; a chain at a point where a variable has no chance at all draws
    evenly, so it finds its way. Chances of 0 between parts of the network can keep chains apart: see :func:`convergence`."""
    tables, values = _dense(factors, known or {})
    names = sorted(values)
    sizes = {v: len(values[v]) for v in names}
    groups = [[v for v in g if v in sizes] for g in coloured([s for s, _ in tables])]
    touching = {v: [(s, a) for s, a in tables if v in s] for v in names}

    def moved(state: dict[str, np.ndarray], v: str, u: np.ndarray) -> np.ndarray:
        lp = np.zeros((len(u), sizes[v]))
        for scope, a in touching[v]:
            axis = scope.index(v)
            lp += np.moveaxis(a, axis, -1)[tuple(state[x] for x in scope if x != v)]
        top = lp.max(axis=1, keepdims=True)
        p = np.where(np.isfinite(top), np.exp(lp - np.where(np.isfinite(top), top, 0)), 1.0)
        c = np.cumsum(p, axis=1)
        return np.minimum((c < (u * c[:, -1])[:, None]).sum(axis=1), sizes[v] - 1)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            draws = [np.random.default_rng([seed, int(i)]) for i in ids]
            uniform = lambda: np.array([r.random(len(names)) for r in draws])  # noqa: E731, B023
            u = uniform()
            state = {v: np.minimum((u[:, j] * sizes[v]).astype(int), sizes[v] - 1) for j, v in enumerate(names)}
            for sweep in range(discard + keep * every):
                u = uniform()
                for g in groups:
                    new = {v: moved(state, v, u[:, names.index(v)]) for v in g}
                    state.update(new)
                if sweep >= discard and (sweep - discard) % every == every - 1:
                    cols = [pa.array(np.array(values[v], object)[state[v]].tolist(), kinds[v]) for v in names]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), sweep)), *cols], names=["chain", "sweep", *names])

    from pyspark.sql.pandas.types import to_arrow_type

    fields = {f.name: f.dataType for x in factors for f in x.schema.fields}
    kinds = {v: to_arrow_type(fields[v]) for v in names}
    schema = "chain long, sweep long, " + ", ".join(f"`{v}` {fields[v].simpleString()}" for v in names)
    return spark.range(chains).mapInArrow(run, schema)


def posterior(drawn: DataFrame, on: list[str]) -> DataFrame:
    """on and p: the share of the samples."""
    n = drawn.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select(*on, (F.col("n") / F.col("t")).alias("p"))  # one row


def convergence(drawn: DataFrame, variable: str, value: object) -> DataFrame:
    """One row: chains, kept samples of each, and how much wider all samples of whether the variable has the value spread than those of a chain (1 where chains agree; null for
    one chain or one sample, or where nothing varies)."""
    by = drawn.groupBy("chain").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg((F.col(variable) == F.lit(value)).cast("double")).alias("m"), F.var_samp((F.col(variable) == F.lit(value)).cast("double")).alias("v"))
    s = by.agg(F.count(F.lit(1)).alias("chains"), F.avg("n").alias("samples"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    return s.select("chains", "samples", F.sqrt(F.try_divide((F.col("samples") - 1) / F.col("samples") * F.col("w") + F.col("b"), F.col("w"))).alias("spread"))
