"""Counts, ranks, moments, fits and tests as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.functions import special
from cladeframe.operators.scans import scanned


def conditional_probabilities(df: DataFrame, child: str, parents: list[str], weight: Column | None = None) -> DataFrame:
    """P(child given parents) as weighted shares; parent keys that don't occur have no rows, those whose weights sum to 0 have null shares."""
    n = df.groupBy(*parents, child).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("n"))
    return n.withColumn("p", F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy(*parents)).cast("double")))


#: Up to so many values of a child are sent to every task; more are dealt in blocks of so many.
VALUES_EACH = 50_000


def smoothed_probabilities(df: DataFrame, child: str, parents: list[str], alpha: float) -> DataFrame:
    """P(child given parents) with a pseudo-count for every value that the child has anywhere. The result is the product of parent keys and values: every key
    gets a row for each value. Up to VALUES_EACH values go to every task with the counts; more go there in blocks, and a key is repeated once a block."""
    n = df.groupBy(*parents, child).agg(F.count(F.lit(1)).cast("double").alias("n"))
    values = n.select(F.col(child).alias("__value")).distinct()
    keys = n.select(*parents).distinct()
    many = values.count()
    if many <= VALUES_EACH:
        every = keys.crossJoin(F.broadcast(values))  # counted just now
    else:
        blocks = -(-many // VALUES_EACH)
        dealt = values.groupBy(F.pmod(F.xxhash64("__value"), F.lit(blocks)).alias("__block")).agg(F.collect_list(F.struct("__value")).alias("__values"))
        every = keys.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "__block").select(*parents, F.explode("__values").alias("__v")).select(*parents, "__v.__value")
    every = every.withColumnRenamed("__value", child)
    seen = n.toDF(*(f"__{c}" for c in n.columns))
    met = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*parents, child]]
    full = every.join(seen, met, "left").select(*parents, child, (F.coalesce("__n", F.lit(0.0)) + alpha).alias("n"))
    return full.withColumn("p", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(*parents))))


def gaussian_node(df: DataFrame, value: str, parents: list[str], floor: float = 0.001, tied: str | None = None) -> DataFrame:
    """Mean and population variance of a real variable for each key of its parents. ``tied``: "max" gives every key the largest
    variance, "pooled" the one of all, weighted by n - 1."""
    x = df.groupBy(*parents).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("v"))
    if tied:
        all_keys = x.agg(F.max("v").alias("__max"), F.try_divide(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1)).alias("__pooled"))
        x = x.crossJoin(F.broadcast(all_keys)).withColumn("v", F.col(f"__{tied}")).drop("__max", "__pooled")  # one row
    return x.withColumn("variance", F.greatest("v", F.lit(floor))).drop("v")


def mid_ranks(df: DataFrame, value: str, on: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank`` (its place by ``value``, ties sharing the mean of theirs) and ``ties`` (how many rows have that value). Rows are counted by
    value first; the counts' running sums are taken over ranges, so neither a large group nor a continuous column is one task. Rows without a
    value, or with a null group, are left out."""
    on = on or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count(F.lit(1)).alias("ties"))
    ranks = scanned(counts, on, [value], __before=("sum", "ties", False)).withColumn("rank", F.col("__before") + (F.col("ties") + 1) / 2).drop("__before")
    return df.join(ranks.select(*on, value, "rank", "ties"), [*on, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    a = mid_ranks(df.select(x, y), x).withColumnRenamed("rank", "__rx").drop("ties")
    return mid_ranks(a, y).agg(F.corr("__rx", "rank").alias("rho"))


def mann_whitney(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """n_a, n_b, t_a (rank sum), u = n_a n_b + n_a (n_a + 1) / 2 - t_a and z with a continuity correction and ties. z is null if a group is
    empty or all values are equal."""
    r = mid_ranks(df.where(F.col(group).isin(a, b)).select(value, group), value)
    is_a = F.col(group) == a
    s = r.agg(F.count(F.when(is_a, 1)).alias("n_a"), F.count(F.when(~is_a, 1)).alias("n_b"), F.sum(F.when(is_a, F.col("rank"))).alias("t_a"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("ties"))
    n = F.col("n_a") + F.col("n_b")
    s = s.withColumn("u", F.col("n_a") * F.col("n_b") + F.col("n_a") * (F.col("n_a") + 1) / 2 - F.col("t_a"))
    m, v = F.col("n_a") * F.col("n_b") / 2, F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    return s.withColumn("z", F.try_divide(F.abs(F.col("u") - m) - 0.5, F.sqrt(v))).drop("ties")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof and Cramer's V of a contingency table; V is null if either side has one category only."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    x = n.withColumn("ra", F.sum("n").over(W.partitionBy("a"))).withColumn("cb", F.sum("n").over(W.partitionBy("b")))
    # Cells that nobody is in add their expected count: the sum of all expected counts is n, so it needs no rows for them.
    s = x.agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("q"), F.sum("n").alias("t"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    chi = F.col("t") * (F.col("q") - 1)
    return s.select(chi.alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"), F.sqrt(F.try_divide(chi, F.col("t") * F.least(F.col("ka") - 1, F.col("kb") - 1))).alias("cramers_v"))


def t_tests(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """Two-sample t statistics from one aggregate: pooled (t, dof) and Welch (welch_t, welch_dof), and the F ratio of variances. What groups of
    fewer than two values or without spread leave undefined is null."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.where(F.col(group).isin(a, b)).agg(*(f(of(g)).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    na, nb, va, vb = (F.col(c) for c in ("na", "nb", "va", "vb"))
    div = F.try_divide
    cube = lambda n: n.cast("double") * n * (n - 1)  # noqa: E731 (beyond 64 bits from some two million rows on)
    pooled = div((na - 1) * va + (nb - 1) * vb, na + nb - 2)
    se = div(va, na) + div(vb, nb)
    welch = div(se * se, div(va * va, cube(na)) + div(vb * vb, cube(nb)))
    one = F.lit(1.0)
    return s.select(div(F.col("ma") - F.col("mb"), F.sqrt(pooled * (div(one, na) + div(one, nb)))).alias("t"), (na + nb - 2).alias("dof"), div(F.col("ma") - F.col("mb"), F.sqrt(se)).alias("welch_t"), welch.alias("welch_dof"), div(F.greatest(va, vb), F.least(va, vb)).alias("f"))


def ks_two_sample(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """The largest distance between the empirical distributions of two groups; null if either is empty. Running counts over ranges of values."""
    n = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count(F.when(F.col(group) == a, 1)).alias("na"), F.count(F.when(F.col(group) == b, 1)).alias("nb"))
    x = scanned(n, [], [value], ca=("sum", "na", True), cb=("sum", "nb", True))
    total = n.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return x.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.try_divide("ca", "ta") - F.try_divide("cb", "tb"))).alias("d"))  # one row


def z_scores(df: DataFrame, value: str, on: list[str]) -> DataFrame:
    """``df`` with ``z`` by population mean and deviation of its group; null where the group has no spread."""
    s = df.groupBy(*on).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(s, on).withColumn("z", (F.col(value) - F.col("__m")) / F.nullif("__s", F.lit(0.0))).drop("__m", "__s")


def element_quantiles(df: DataFrame, value: str, on: list[str], q: int) -> DataFrame:
    """Cuts of each group at sorted elements k n / q (from 0), k = 1 .. q - 1; no interpolation. Values are counted first and their places
    are running sums over ranges, so a hot group isn't one task."""
    n = df.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count(F.lit(1)).alias("__c"))
    size = n.groupBy(*on).agg(F.sum("__c").alias("__n"))
    x = scanned(n, on, [value], __b=("sum", "__c", False))
    met = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in on]
    size = size.select(*(F.col(c).alias(f"__g_{c}") for c in on), "__n")
    x = x.join(size, met) if on else x.crossJoin(F.broadcast(size))  # one row
    at = lambda k: F.floor(F.col("__n") * k / q)
    cuts = x.withColumn("k", F.explode(F.array_compact(F.array(*(F.when((at(k) >= F.col("__b")) & (at(k) < F.col("__b") + F.col("__c")), k) for k in range(1, q))))))
    return cuts.select(*on, "k", F.col(value).alias("cut"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float] | None:
    """Exact quantiles of a column, interpolated between neighbours; None without values."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = n.agg(F.sum("c")).first()[0]
    if not total:
        return None
    x = scanned(n, [], ["v"], b=("sum", "c", False))
    ends = sorted({f for s in shares for f in (int((total - 1) * s), min(total - 1, int((total - 1) * s) + 1))})
    found = {}
    hit = F.exists(F.array(*map(F.lit, ends)), lambda e: (e >= F.col("b")) & (e < F.col("b") + F.col("c")))
    for r in x.where(hit).collect():  # two values a quantile
        found |= {e: r.v for e in ends if r.b <= e < r.b + r.c}
    out = []
    for s in shares:
        low = int((total - 1) * s)
        part = (total - 1) * s - low
        out.append(found[low] * (1 - part) + found[min(total - 1, low + 1)] * part)
    return out


def fits(df: DataFrame, value: str, on: list[str]) -> DataFrame:
    """Closed-form fits of each group's positive values from one aggregate: exponential rate, log-normal (mu, sigma), gamma (shape, scale),
    continuous power law above the minimum (alpha), and mean and population variance of the Gaussian. What a group without spread leaves undefined
    (sigma of one value; shape, scale and alpha of equal values) is null."""
    x, ln = F.col(value), F.log(value)
    s = df.where(x > 0).groupBy(*on).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.avg(ln).alias("mu"), F.stddev_samp(ln).alias("sigma"), F.min(x).alias("least"))
    g = F.log("mean") - F.col("mu")
    g = F.when(F.col("n") > 1, F.when(F.col("variance") > 0, F.greatest(g, F.lit(0.0))))
    shape = F.try_divide(3 - g + F.sqrt((g - 3) * (g - 3) + 24 * g), 12 * g)
    return s.select(*on, "n", "mean", "variance", F.try_divide(F.lit(1.0), F.col("mean")).alias("exp_rate"), F.col("mu").alias("lognormal_mu"), F.col("sigma").alias("lognormal_sigma"), shape.alias("gamma_shape"), F.try_divide(F.col("mean"), shape).alias("gamma_scale"), (1 + F.try_divide(F.lit(1.0), F.when(F.col("variance") > 0, F.col("mu") - F.log("least")))).alias("power_alpha"))


def zero_inflated_gamma(df: DataFrame, value: str, on: list[str]) -> DataFrame:
    """Share of zeros, and shape and scale of the positive values by moments: scale = population variance / mean. Without positive values both are
    null, without spread the shape is."""
    x = F.when(F.col(value) > 0, F.col(value))
    s = df.groupBy(*on).agg(F.avg((F.col(value) == 0).cast("double")).alias("zeros"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    return s.select(*on, "zeros", F.try_divide(F.col("m") * F.col("m"), F.col("v")).alias("shape"), F.try_divide(F.col("v"), F.col("m")).alias("scale"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0), lo, hi and n of equal bins; values outside go to the first and last."""
    width = (high - low) / bins
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)))
    n = df.where(F.col(value).isNotNull()).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), "n")


def empirical_distribution(df: DataFrame, value: str) -> DataFrame:
    """value, p and cdf: shares of each value and of all up to it (a null value comes first). Running counts over ranges of values."""
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    x = scanned(n, [], [value], __upto=("sum", "__n", True)).crossJoin(F.broadcast(n.agg(F.sum("__n").alias("__t"))))  # one row
    return x.select(value, (F.col("__n") / F.col("__t")).alias("p"), (F.col("__upto") / F.col("__t")).alias("cdf"))


def column_entropy(df: DataFrame, symbol: str, on: list[str]) -> DataFrame:
    """Natural-log entropy of the symbols of each group; null symbols count in the denominator only."""
    n = df.groupBy(*on, symbol).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(*on))
    return n.withColumn("p", p).groupBy(*on).agg((-F.sum(F.when(F.col(symbol).isNotNull(), F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"))


def good_turing_line(df: DataFrame, species: str) -> DataFrame:
    """Slope and intercept of ln(frequency of frequency) on ln(frequency): the regression of the smoothing. n rows have at most sqrt(2 n) different
    frequencies, which are what the window orders."""
    f = df.groupBy(species).agg(F.count(F.lit(1)).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("nr"))
    w = W.orderBy("r")
    q, t = F.coalesce(F.lag("r").over(w), F.lit(0)), F.lead("r").over(w)
    z = F.when(t.isNotNull(), F.col("nr") * 2.0 / (t - q)).otherwise(F.col("nr") / (F.col("r") - q).cast("double"))
    x = f.withColumn("z", z)
    return x.agg(F.regr_slope(F.log("z"), F.log("r")).alias("slope"), F.regr_intercept(F.log("z"), F.log("r")).alias("intercept"))


def poisson_log_likelihood(df: DataFrame, value: str, on: list[str]) -> DataFrame:
    """Rate and log-likelihood of each group's counts. Rows are counted by value first, so that ln k! is worked out once for each."""
    k = df.groupBy(*on, value).agg(F.count(value).alias("__n"))
    x = k.withColumn("__lf", F.col("__n") * special.lgamma_col(F.col(value).cast("double") + 1))
    s = x.groupBy(*on).agg(F.sum("__n").alias("n"), (F.sum(F.col("__n") * F.col(value)) / F.nullif(F.sum("__n"), F.lit(0))).alias("rate"), F.sum(F.when(F.col(value).isNotNull(), F.col("__lf"))).alias("lf"))
    told = F.when(F.col("rate") == 0, 0.0).otherwise(F.col("n") * F.col("rate") * (F.log("rate") - 1))  # a rate of 0 gives zeros surely
    return s.select(*on, "rate", (told - F.col("lf")).alias("log_likelihood"))


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")
