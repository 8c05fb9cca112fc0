"""Factor algebra: a factor is a DataFrame of key columns and ``lp``, the log of its value.

Product is a natural join, marginalising a grouped log-sum, maximising out a grouped maximum, evidence a
selection. Every aggregate is split into partial and final by Spark, so a hot key is summed before its shuffle.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "lp"


def variables(factor: DataFrame) -> list[str]:
    return [c for c in factor.columns if c != VALUE]


def overlap(x: DataFrame, y: DataFrame) -> list[str]:
    return [c for c in variables(x) if c in y.columns]


def from_counts(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """The factor of (weighted) counts of the keys' values."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys).agg(F.log(F.sum(w)).alias(VALUE))


#: Without a shared variable, a factor of up to so many rows goes to every task; of two larger ones the second is dealt in blocks of so many.
PRODUCT_ROWS = 100_000


def product(x: DataFrame, y: DataFrame) -> DataFrame:
    """Natural join on the shared variables, values multiplied. Factors without shared variables have a product as large as both together: the smaller one is
    sent to the other's rows if it is small (PRODUCT_ROWS, checked); otherwise ``y`` is dealt in blocks and each row of ``x`` meets one block at a time."""
    shared = overlap(x, y)
    right = y.withColumnRenamed(VALUE, "__lp")
    keys = [*variables(x), *(c for c in variables(y) if c not in shared)]
    if shared:
        joined = x.join(right, shared)
    elif y.limit(PRODUCT_ROWS + 1).count() <= PRODUCT_ROWS:
        joined = x.crossJoin(F.broadcast(right))
    elif x.limit(PRODUCT_ROWS + 1).count() <= PRODUCT_ROWS:
        joined = right.crossJoin(F.broadcast(x))
    else:
        blocks = -(-y.count() // PRODUCT_ROWS)
        dealt = right.groupBy(F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).alias("__block")).agg(F.collect_list(F.struct(*right.columns)).alias("__rows"))
        joined = x.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "__block").select(*x.columns, F.explode("__rows").alias("__r")).select(*x.columns, "__r.*")
    return joined.select(*keys, (F.col(VALUE) + F.col("__lp")).alias(VALUE))


def marginal(factor: DataFrame, keep: list[str]) -> DataFrame:
    """Sums out all variables but ``keep``. Each group's values are summed within bands of 500 log units relative to the band, then the bands relative to
    the group's highest: no group is lost however far it lies below another, in one reading of the factor and with partial sums before each shuffle.
    A value of 0 has the log minus infinity; a group of nothing else has it too. Null logs are left out."""
    lp = F.col(VALUE)
    fine = factor.where(lp.isNotNull()).withColumn("__band", F.when(lp > float("-inf"), F.floor(lp / 500)))
    part = fine.groupBy(*keep, "__band").agg(F.sum(F.exp(lp - F.col("__band") * 500)).alias("__s"))
    part = part.withColumn("__l", F.log("__s") + F.col("__band") * 500)
    # A group has few bands: their logs in one array, summed relative to the largest.
    logs = part.groupBy(*keep).agg(F.collect_list("__l").alias("__ls"))  # nulls (value 0) are left out
    top = F.array_max("__ls")
    total = top + F.log(F.aggregate("__ls", F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    return logs.select(*keep, F.coalesce(total, F.lit(float("-inf"))).alias(VALUE))


def maximum(factor: DataFrame, keep: list[str]) -> DataFrame:
    """Maximises out all variables but ``keep``: the best value and, as ``best_<variable>``, the assignment that has it; the smallest among equals."""
    out = [c for c in variables(factor) if c not in keep]
    tie = factor.groupBy(*keep).agg(F.min(F.struct((-F.col(VALUE)).alias("__less"), *out)).alias("__m"))
    return tie.select(*keep, (-F.col("__m.__less")).alias(VALUE), *(F.col(f"__m.{c}").alias(f"best_{c}") for c in out))


def normalised(factor: DataFrame) -> DataFrame:
    """Values divided by their sum; null if that is 0."""
    total = marginal(factor, []).select(F.when(F.col(VALUE) > float("-inf"), F.col(VALUE)).alias("__t"))
    return factor.crossJoin(F.broadcast(total)).select(*variables(factor), (F.col(VALUE) - F.col("__t")).alias(VALUE))


def log_total(factor: DataFrame) -> DataFrame:
    return marginal(factor, [])


def evidence(factor: DataFrame, known: dict[str, object]) -> DataFrame:
    """Rows that agree with the known values; their columns go."""
    rows = reduce(lambda d, kv: d.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), ((k, v) for k, v in known.items() if k in factor.columns), factor)
    return rows.drop(*known)


def matches(factor: DataFrame, key: dict[str, object]) -> DataFrame:
    """Rows that a partial key matches; a null in the key matches anything."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in key.items() if v is not None), factor)


def decomposed(factor: DataFrame, n: int) -> dict[tuple[str, ...], DataFrame]:
    """All marginals of n variables."""
    return {c: marginal(factor, list(c)) for c in combinations(variables(factor), n)}


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """var_a, var_b, mi: mutual information in bits of every pair of columns over the rows of ``df``.

    All pair and single counts come from one pass with grouping sets; the joins are between tables of counts.
    """
    pairs = list(combinations(columns, 2))
    sets = [[a, b] for a, b in pairs] + [[c] for c in columns] + [[]]
    g = df.select(*columns).groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    full = (1 << len(columns)) - 1
    gid = lambda cs: full - sum(bit[c] for c in cs)
    total = g.where(F.col("gid") == full).select(F.col("n").alias("t"))
    parts = []
    for a, b in pairs:
        xy = g.where(F.col("gid") == gid([a, b])).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("n").alias("nab"))
        x = g.where(F.col("gid") == gid([a])).select(F.col(a).alias("xa"), F.col("n").alias("na"))
        y = g.where(F.col("gid") == gid([b])).select(F.col(b).alias("yb"), F.col("n").alias("nb"))
        j = xy.join(x, F.col("a").eqNullSafe(F.col("xa"))).join(y, F.col("b").eqNullSafe(F.col("yb"))).crossJoin(F.broadcast(total))
        parts.append(j.agg(F.sum(F.col("nab") / F.col("t") * F.log2(F.col("nab") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi")).select(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), "mi"))
    return reduce(DataFrame.unionByName, parts)


def join_order(sizes: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Greedy order of pairwise products: next the pair whose result has the fewest cells. ``sizes``: domain sizes by variable.
    Pairs are numbers of operands; each result takes the next number."""
    left = dict(enumerate(sizes))
    order, new = [], len(sizes)
    while len(left) > 1:
        cells = lambda p: reduce(lambda a, b: a * b, (left[p[0]] | left[p[1]]).values(), 1)
        a, b = min(combinations(sorted(left), 2), key=cells)
        order.append((a, b))
        left[new] = left.pop(a) | left.pop(b)
        new += 1
    return order


def products(factors: list[DataFrame], sizes: list[dict[str, int]]) -> DataFrame:
    """The product of all, in the greedy order."""
    made = dict(enumerate(factors))
    for k, (a, b) in enumerate(join_order(sizes)):
        made[len(factors) + k] = product(made.pop(a), made.pop(b))
    (out,) = made.values()
    return out


def eliminate(factors: list[DataFrame], order: list[str], known: dict[str, object] | None = None, maximise: bool = False) -> DataFrame:
    """Bucket elimination: for each variable in ``order``, the product of the factors that have it, summed (or maximised) out."""
    left = [evidence(f, known or {}) for f in factors]
    for v in order:
        mine = [f for f in left if v in f.columns]
        if not mine:
            continue
        joint = reduce(product, mine)
        keep = [c for c in variables(joint) if c != v]
        made = joint.groupBy(*keep).agg(F.max(VALUE).alias(VALUE)) if maximise else marginal(joint, keep)
        left = [f for f in left if v not in f.columns] + [made]
    return reduce(product, left)


def posterior(factors: list[DataFrame], order: list[str], known: dict[str, object] | None = None) -> DataFrame:
    """The distribution of what is not eliminated, given the evidence: columns and ``p``."""
    x = normalised(eliminate(factors, order, known))
    return x.select(*variables(x), F.exp(VALUE).alias("p"))
