"""Parameter learning: expected counts by joins and grouped sums, one round a plan; parameters of few values return to the driver."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.plans.session import checkpointed


def noisy_or(active: list[Column], chances: list[float], leak: float = 0.0) -> Column:
    """P(child) = 1 - (1 - leak) * product of (1 - p) over the active parents."""
    miss = F.lit(math.log1p(-leak))
    for a, p in zip(active, chances):
        miss = miss + F.when(a, F.log1p(F.lit(-min(p, 1 - 1e-15)))).otherwise(0.0)
    return 1 - F.exp(miss)


def gaussian_mixture(df: DataFrame, value: str, k: int, rounds: int = 100, tolerance: float = 1e-6, floor: float = 1e-3) -> tuple[list[float], list[float], list[float], float]:
    """Weights, means, variances and log-likelihood of a one-dimensional mixture by EM. Each round is one aggregate of 3 k + 1 sums;
    it begins with equal weights and means at the approximate quantiles."""
    x = F.col(value).cast("double")
    data = df.select(x.alias("x")).where(F.col("x").isNotNull())
    first = data.agg(F.percentile_approx("x", [(i + 0.5) / k for i in range(k)], 10_000), F.var_pop("x"), F.count("x")).first()
    if not first[2]:
        return [1 / k] * k, [0.0] * k, [floor] * k, 0.0
    w, m, v, was = [1 / k] * k, list(first[0]), [max(floor, first[1])] * k, -math.inf
    for _ in range(rounds):
        dens = [F.lit(w[i] / math.sqrt(2 * math.pi * v[i])) * F.exp(-(F.col("x") - m[i]) * (F.col("x") - m[i]) / (2 * v[i])) for i in range(k)]
        total = sum(dens[1:], dens[0]) + 1e-300
        r = [d / total for d in dens]
        s = data.agg(F.sum(F.log(total)), *(f for i in range(k) for f in (F.sum(r[i]), F.sum(r[i] * F.col("x")), F.sum(r[i] * F.col("x") * F.col("x"))))).first()
        for i in range(k):
            n, sx, sxx = s[1 + 3 * i : 4 + 3 * i]
            w[i], m[i] = n / first[2], sx / max(n, 1e-300)
            v[i] = max(floor, sxx / max(n, 1e-300) - m[i] ** 2)
        if abs(s[0] - was) <= tolerance * abs(s[0]):
            break
        was = s[0]
    return w, m, v, float(s[0])


def latent_class(counts: DataFrame, columns: list[str], k: int, rounds: int = 50, seed: int = 1) -> DataFrame:
    """class, variable, value, p of a network with one hidden parent of ``columns``, by EM on grouped rows (``n``: how many
    are alike). A round joins the rows with the tables of each variable and sums expected counts; what stays on the driver is nothing.
    The first tables are drawn by hash, so reruns agree."""
    from functools import reduce

    spark = counts.sparkSession
    rows = counts.select(*columns, "n").withColumn("row", F.xxhash64(*columns))
    longs = reduce(DataFrame.unionByName, [rows.select("row", "n", F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])
    longs = checkpointed(longs)
    classes = spark.range(k).select(F.col("id").cast("int").alias("class"))
    noise = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1000)) / 1000 + 0.5
    r = rows.select("row").distinct().crossJoin(F.broadcast(classes)).withColumn("r", noise("row", "class"))
    for i in range(rounds):
        total = r.groupBy("row").agg(F.sum("r").alias("t"))
        r = r.join(total, "row").select("row", "class", (F.col("r") / F.col("t")).alias("r"))
        expected = checkpointed(longs.join(r, "row").groupBy("class", "variable", "value").agg(F.sum(F.col("n") * F.col("r")).alias("e")))
        sums = expected.groupBy("class", "variable").agg(F.sum("e").alias("s"))
        table = expected.join(sums, ["class", "variable"]).select("class", "variable", "value", ((F.col("e") + 1e-6) / (F.col("s") + 1e-6)).alias("p"), "s")
        if i == rounds - 1:
            return table.drop("s")
        prior = sums.where(F.col("variable") == columns[0]).select("class", F.log("s").alias("prior"))
        like = longs.select("row", "variable", "value").distinct().join(table, ["variable", "value"]).groupBy("row", "class").agg(F.sum(F.log("p")).alias("lp"))
        scored = like.join(prior, "class").withColumn("lp", F.col("lp") + F.col("prior"))
        top = scored.groupBy("row").agg(F.max("lp").alias("top"))
        r = scored.join(top, "row").select("row", "class", F.exp(F.col("lp") - F.col("top")).alias("r"))
        if i % 3 == 2:
            r = checkpointed(r)
    raise ValueError("at least one round")


def dirichlet_fit(df: DataFrame, probabilities: str, rounds: int = 100, tolerance: float = 1e-8) -> list[float]:
    """Alpha of a Dirichlet distribution by Newton steps; the data are one aggregate of mean logs, a value for each component."""
    from cladeframe.functions.special import digamma

    n = df.agg(F.max(F.size(probabilities))).first()[0] or 0
    means = df.agg(*(F.avg(F.log(F.greatest(F.element_at(probabilities, i + 1), F.lit(1e-12)))) for i in range(n)), *(F.avg(F.element_at(probabilities, i + 1)) for i in range(n))).first() if n else ()
    logs, alpha = np.array(means[:n], float), np.maximum(1e-3, n * np.array(means[n:], float))
    trigamma = lambda x: (digamma(x + 1e-4) - digamma(x - 1e-4)) / 2e-4
    for _ in range(rounds):
        g = digamma(np.array([alpha.sum()]))[0] - digamma(alpha) + logs
        q, z = -trigamma(alpha), trigamma(np.array([alpha.sum()]))[0]
        step = (g - (g / q).sum() / (1 / z + (1 / q).sum())) / q
        new = np.maximum(alpha - step, alpha / 2)
        done = np.abs(new - alpha).max() < tolerance
        alpha = new
        if done:
            break
    return alpha.tolist()


def pairwise_alignments(pairs: DataFrame, match: float = 1.0, mismatch: float = -1.0, open_gap: float = -4.0, extend: float = -2.0) -> DataFrame:
    """``pairs`` (a, b: strings) with score, aligned_a and aligned_b: global alignment with affine gaps. A map over Arrow batches; the
    dynamic program goes along anti-diagonals in NumPy, so a pair costs memory in the product of its lengths."""

    def run(batches):
        for batch in batches:
            out = [align(x or "", y or "", match, mismatch, open_gap, extend) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=[*batch.schema.names, "score", "aligned_a", "aligned_b"])

    from pyspark.sql import types as T

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("aligned_a", T.StringType()), T.StructField("aligned_b", T.StringType())]))


def align(a: str, b: str, match: float, mismatch: float, open_gap: float, extend: float) -> tuple[float, str, str]:
    """Score and both aligned strings; of equal scores a pair comes before a gap in b, and that before one in a."""
    n, m = len(a), len(b)
    low = -1e18
    best = np.full((3, n + 1, m + 1), low)  # ends in a pair, a gap in b, a gap in a
    best[0, 0, 0] = 0
    best[1, 1:, 0] = open_gap + extend * np.arange(n)
    best[2, 0, 1:] = open_gap + extend * np.arange(m)
    x, y = np.array([ord(c) for c in a]), np.array([ord(c) for c in b])
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        best[0, i, j] = best[:, i - 1, j - 1].max(axis=0) + np.where(x[i - 1] == y[j - 1], match, mismatch)
        best[1, i, j] = np.maximum(np.maximum(best[0, i - 1, j], best[2, i - 1, j]) + open_gap, best[1, i - 1, j] + extend)
        best[2, i, j] = np.maximum(np.maximum(best[0, i, j - 1], best[1, i, j - 1]) + open_gap, best[2, i, j - 1] + extend)
    i, j, k = n, m, int(best[:, n, m].argmax())
    score, p, q = float(best[k, n, m]), [], []
    while i or j:
        here = best[k, i, j]
        if k == 0:
            p.append(a[i - 1]), q.append(b[j - 1])
            i, j = i - 1, j - 1
            k = int(best[:, i, j].argmax())
        elif k == 1:
            p.append(a[i - 1]), q.append("-")
            i -= 1
            k = 1 if i and abs(best[1, i, j] + extend - here) < 1e-9 else int(np.where([True, False, True], best[:, i, j], low).argmax()) if i or j else 0
        else:
            p.append("-"), q.append(b[j - 1])
            j -= 1
            k = 2 if j and abs(best[2, i, j] + extend - here) < 1e-9 else int(np.where([True, True, False], best[:, i, j], low).argmax()) if i or j else 0
    return score, "".join(p[::-1]), "".join(q[::-1])


def edit_profile(df: DataFrame, on: list[str], pos: str, sym: str) -> DataFrame:
    """Counts of symbols by column: the profile of aligned sequences."""
    return df.groupBy(*on, pos, sym).agg(F.count(F.lit(1)).alias("n"))


def dirichlet_mixture(df: DataFrame, counts: str, k: int, rounds: int = 100, tolerance: float = 1e-7, seed: int = 1) -> tuple[list[float], list[list[float]], float]:
    """Weights, alphas and log-likelihood of a mixture of Dirichlet distributions over ``counts`` (arrays of one length), by EM with a fixed-point step.

    A round is one map with partial sums, a few numbers a component and task, and one grouped sum. Rows with a null array are left out; an array shorter than the longest
    counts as ending in zeros. The first alphas are the mean shares, disturbed by the seed. The likelihood leaves out the multinomial coefficients.
    """
    from cladeframe.functions.special import digamma, log_gamma

    n = df.agg(F.max(F.size(counts))).first()[0] or 0
    data = df.where(F.col(counts).isNotNull()).select(F.col(counts).cast("array<double>").alias("c"))
    total = [x or 0.0 for x in data.agg(*(F.sum(F.coalesce(F.get("c", F.lit(i)), F.lit(0.0))) for i in range(n))).first()] if n > 0 else []
    if not sum(total):
        return [1 / k] * k, [[1.0] * max(n, 0)] * k, 0.0
    share = np.maximum(np.array(total) / sum(total), 1e-6)
    alpha = n * share * np.random.default_rng(seed).uniform(0.5, 1.5, (k, n))
    weights, was, loglik = np.full(k, 1 / k), -math.inf, 0.0
    data = data.persist()
    try:
        for _ in range(rounds):

            def sums(batches, alpha=alpha, weights=weights):
                out = np.zeros((k, n + 2))
                like = 0.0
                for batch in batches:
                    for at in range(0, batch.num_rows, 1024):
                        x = np.zeros((min(1024, batch.num_rows - at), n))
                        for i, row in enumerate(batch.column("c").slice(at, 1024).to_pylist()):
                            x[i, : len(row)] = [v or 0 for v in row]
                        size, a = x.sum(axis=1), alpha.sum(axis=1)
                        lp = np.stack([log_gamma(np.full(len(x), a[c])) - log_gamma(size + a[c]) + (log_gamma(x + alpha[c]) - log_gamma(alpha[c])).sum(axis=1) for c in range(k)], axis=1) + np.log(np.maximum(weights, 1e-300))
                        top = lp.max(axis=1, keepdims=True)
                        r = np.exp(lp - top)
                        like += float((top[:, 0] + np.log(r.sum(axis=1))).sum())
                        r /= r.sum(axis=1, keepdims=True)
                        for c in range(k):
                            out[c, :n] += r[:, c] @ (digamma(x + alpha[c]) - digamma(alpha[c]))
                            out[c, n] += r[:, c] @ (digamma(size + a[c]) - digamma(a[c : c + 1]))
                            out[c, n + 1] += r[:, c].sum()
                flat = np.append(out.ravel(), like)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "g"])

            got = data.mapInArrow(sums, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).orderBy("k").collect()  # a number for each parameter
            flat = np.array([r.g for r in got])
            loglik, s = float(flat[-1]), flat[:-1].reshape(k, n + 2)
            weights = s[:, n + 1] / s[:, n + 1].sum()
            alpha = np.clip(alpha * s[:, :n] / np.maximum(s[:, n : n + 1], 1e-300), 1e-6, 1e6)
            if abs(loglik - was) <= tolerance * abs(loglik):
                break
            was = loglik
    finally:
        data.unpersist()
    return weights.tolist(), alpha.tolist(), loglik


def boolean_rbm(df: DataFrame, visible: str, hidden: int, rounds: int = 50, rate: float = 0.1, momentum: float = 0.9, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and biases of a restricted Boltzmann machine over ``visible`` (array of 0 and 1) by contrastive divergence.

    A round is one map with partial sums of the gradient, a row a task, and one grouped sum; hidden units are drawn by a generator seeded with the round
    and the rows, so a repeated task gives the same sums. The parameters are a matrix of visible by hidden units.
    """
    n = df.agg(F.max(F.size(visible))).first()[0] or 0
    return _divergence(df, visible, n, hidden, lambda v: v, _sigmoid, rounds, rate, momentum, seed)


def multinomial_rbm(df: DataFrame, visible: str, values: int, hidden: int, rounds: int = 50, rate: float = 0.1, momentum: float = 0.9, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for ``visible`` units with ``values`` states (array of 0 .. values - 1): each unit is one softmax. The weights are of units x values by hidden units."""
    n = df.agg(F.max(F.size(visible))).first()[0] or 0

    def softmax(x: np.ndarray) -> np.ndarray:
        units = x.reshape(len(x), -1, values)
        e = np.exp(units - units.max(axis=2, keepdims=True))
        return (e / e.sum(axis=2, keepdims=True)).reshape(x.shape)

    return _divergence(df, visible, n * values, hidden, lambda v: np.eye(values)[v.astype(int)].reshape(len(v), -1), softmax, rounds, rate, momentum, seed)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _divergence(df: DataFrame, visible: str, n: int, hidden: int, coded, shown, rounds: int, rate: float, momentum: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds of contrastive divergence; ``coded`` turns rows into units, ``shown`` a unit's input into its chance. Rows with a null array are left out."""
    rng = np.random.default_rng(seed)
    w, a, b = rng.normal(0, 0.01, (n, hidden)), np.zeros(n), np.zeros(hidden)
    change = [np.zeros_like(x) for x in (w, a, b)]
    known = df.where(F.col(visible).isNotNull()).select(visible)
    for r in range(rounds):

        def gradient(batches, w=w, a=a, b=b, r=r):
            total, count = np.zeros(n * hidden + n + hidden), 0
            for batch in batches:
                v = np.array(batch.column(visible).to_pylist(), float)
                if len(v):
                    v = coded(v)
                    own = np.random.default_rng([seed, r, len(v), int(v.sum())])
                    h = _sigmoid(v @ w + b)
                    v2 = shown((own.random(h.shape) < h) @ w.T + a)
                    h2 = _sigmoid(v2 @ w + b)
                    total += np.concatenate([(v.T @ h - v2.T @ h2).ravel(), (v - v2).sum(axis=0), (h - h2).sum(axis=0)])
                    count += len(v)
            k = np.arange(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(total, float(count)))], names=["k", "g"])

        sums = {x.k: x.g for x in known.mapInArrow(gradient, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()}  # a number for each parameter
        rows = max(1.0, sums.pop(-1, 0.0))
        g = np.array([sums[k] for k in range(len(sums))]) / rows if sums else np.zeros(n * hidden + n + hidden)
        parts = g[: n * hidden].reshape(n, hidden), g[n * hidden : n * hidden + n], g[n * hidden + n :]
        change = [momentum * c + rate * p for c, p in zip(change, parts)]
        w, a, b = (x + c for x, c in zip((w, a, b), change))
    return w, a, b
