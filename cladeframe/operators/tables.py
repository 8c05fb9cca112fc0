"""Operators on wide tables: concatenation by position, transposition, flattening, type predicates and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positional_join(a: DataFrame, b: DataFrame, a_order: list[str], b_order: list[str]) -> DataFrame:
    """Rows of both tables side by side, by place in their orders; columns of ``b`` that clash get the prefix ``b_``. Places are
    counted per range partition and moved by the sums of those before, so no task holds all rows. Rows without a partner are left out."""
    x, y = numbered(a, a_order, "__i"), numbered(b, b_order, "__i")
    y = y.select("__i", *(F.col(c).alias(f"b_{c}" if c in a.columns else c) for c in b.columns))
    return x.join(y, "__i").drop("__i")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its place (from 0) in an order that has no ties: range partitions, their sizes' prefix sums, and a count within."""
    from pyspark.sql import Window as W

    from cladeframe.plans.session import checkpointed

    parts = checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    within = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return parts.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + within).drop("__p", "__s")  # a row for each partition


def transposed(df: DataFrame, key: str, columns: list[str], names: list) -> DataFrame:
    """A row for each of ``columns`` and a column for each key in ``names``; a key should occur once."""
    long = df.select(key, *(F.col(c).cast("string") for c in columns)).unpivot(key, columns, "column", "cell")
    return long.groupBy("column").pivot(key, names).agg(F.first("cell"))


def distinct_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of several columns as text; nulls are left out."""
    return df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("cell")).where("cell IS NOT NULL").distinct()


def all_of_type(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """column and whether all its cells that aren't null can be read as ``kind``."""
    r = df.agg(*(F.bool_and(F.col(c).cast("string").try_cast(kind).isNotNull() | F.col(c).isNull()).alias(c) for c in columns))
    return r.unpivot([], columns, "column", "fits")


def flattened(df: DataFrame, sample: str, item: str, feature: str, value: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """A row for each sample with a column ``item__feature`` for each pair wanted."""
    pick = lambda i, f: F.max(F.when((F.col(item) == i) & (F.col(feature) == f), F.col(value))).alias(f"{i}__{f}")
    return df.groupBy(sample).agg(*(pick(i, f) for i, f in wanted))


def matches_key(key: dict[str, Column]) -> Column:
    """A partial key: null matches anything."""
    out = F.lit(True)
    for name, k in key.items():
        out = out & (k.isNull() | (k == F.col(name)))
    return out


def colour_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``df`` with ``bin`` (1 to bins) of equal width between the value's extremes."""
    s = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    b = F.least(F.lit(bins), F.floor((F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins) + 1)
    return df.crossJoin(F.broadcast(s)).withColumn("bin", F.when(F.col("__b") > F.col("__a"), b).otherwise(1).cast("int")).drop("__a", "__b")  # one row


def stratified_sample(df: DataFrame, stratum: str, id_col: str, share: float, seed: str = "0") -> DataFrame:
    """The same share of each stratum, rounded up: those of the least hash of their id, so reruns agree."""
    from pyspark.sql import Window as W

    w = W.partitionBy(stratum)
    x = df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))))
    return x.withColumn("__k", F.row_number().over(w.orderBy("__h", id_col))).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__k") <= F.ceil(F.col("__n") * share)).drop("__h", "__k", "__n")


def kernel_density(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """x and density at the points of a grid: Gaussian kernels with bandwidth 1.06 min(sd, IQR / 1.34) n^(-1/5). One aggregate over the data
    with a sum for each grid point. Without values, or where the bandwidth is 0 (equal values), the density is null."""
    from cladeframe.operators.statistics import quantiles

    v = F.col(value).cast("double")
    s, q = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd")).first(), quantiles(df, value, [0.25, 0.75])
    h = 1.06 * min(s["sd"] or 0.0, (q[1] - q[0]) / 1.34) * s["n"] ** -0.2 if q else 0.0
    at = [F.avg(F.exp(-(v - g) * (v - g) / (2 * h * h)) / (h * (2 * 3.141592653589793) ** 0.5)) if h > 0 else F.first(F.lit(None).cast("double")) for g in grid]
    return df.agg(F.array(*at).alias("d")).select(F.posexplode("d").alias("i", "density")).select(F.element_at(F.array(*map(F.lit, grid)), F.col("i") + 1).alias("x"), "density")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns, null if either is constant or there are no rows. Rows with a null are left out.

    Cells (x, y, rows) take the rank of their y. Two ranks differ first, from the highest, in one binary digit: among the cells with equal higher digits, pairs with
    different x are counted at that digit by running sums in the order of x. So each cell stands once a digit of the number of distinct y, pairs are never
    listed, and no task holds more than a range.
    """
    from cladeframe.operators.scans import scanned

    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    ys = n.select("y").distinct()
    digits = max(1, ys.count().bit_length())
    ranks = scanned(ys.withColumn("one", F.lit(1).cast("long")), [], ["y"], rank=("sum", "one", False)).select("y", "rank")
    each = n.join(ranks, "y").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))))
    high = F.call_function("shiftright", F.col("rank"), F.col("level") + 1)
    bit = F.call_function("shiftright", F.col("rank"), F.col("level")).bitwiseAND(F.lit(1).cast("long"))
    sums = each.groupBy("level", high.alias("high"), "x").agg(F.coalesce(F.sum(F.when(bit == 1, F.col("n"))), F.lit(0)).cast("decimal(38,0)").alias("ones"), F.coalesce(F.sum(F.when(bit == 0, F.col("n"))), F.lit(0)).cast("decimal(38,0)").alias("zeros"))
    ran = scanned(sums, ["level", "high"], ["x"], ones_before=("sum", "ones", False), zeros_before=("sum", "zeros", False))
    d = lambda c: F.col(c).cast("double")
    s = ran.agg(F.sum(d("ones") * d("zeros_before") - d("zeros") * d("ones_before")).alias("s"))
    total = n.agg(F.sum(d("n")).alias("t"))
    ties = lambda c: n.groupBy(c).agg(F.sum(d("n")).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(f"t{c}"))
    j = s.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(ties("x"))).crossJoin(F.broadcast(ties("y")))  # one row each
    all_pairs = F.col("t") * (F.col("t") - 1) / 2
    return j.select(F.try_divide(F.col("s"), F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty")))).alias("tau"))
