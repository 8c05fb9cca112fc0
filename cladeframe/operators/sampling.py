"""Sampling from networks: rows drawn top-down by joins with conditional tables, and posteriors by likelihood weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A conditional table: the child's name, its parents' names, and a DataFrame of parents, child and ``p``.
Table = tuple[str, list[str], DataFrame]


def weighted_samples(spark: SparkSession, n: int, tables: list[Table], known: dict[str, object] | None = None, seed: int = 0) -> DataFrame:
    """id, a column for each variable, and ``weight``: ``n`` draws of a network whose tables come in an order of parents before children.

    Known variables aren't drawn: their probability given the drawn parents multiplies the weight. A draw's numbers are hashes of its id, the variable and
    the seed, so a repeated task gives the same ones. Each variable is one equi-join on its parents; a row meets only its parents' values, then keeps
    the one whose share of [0, 1) holds its number. Parent values that a table lacks end the draw.
    """
    known = known or {}
    x = spark.range(n).withColumn("weight", F.lit(1.0))
    for child, parents, table in tables:
        if child in known:
            rows = table.where(F.col(child) == F.lit(known[child])).select(*parents, F.col("p").alias("__p"))
            x = (x.join(rows, parents) if parents else x.crossJoin(F.broadcast(rows))).withColumn("weight", F.col("weight") * F.col("__p")).withColumn(child, F.lit(known[child])).drop("__p")
            continue
        w = W.partitionBy(*parents).orderBy(child) if parents else W.orderBy(child)
        high = F.sum("p").over(w.rowsBetween(W.unboundedPreceding, 0))
        rows = table.select(*parents, child, (high - F.col("p")).alias("__lo"), high.alias("__hi"), F.row_number().over(w).alias("__k"), F.count(F.lit(1)).over(W.partitionBy(*parents)).alias("__n"))
        # One array for each parent key: a row is joined once, not once for each value.
        cells = rows.groupBy(*parents).agg(F.sort_array(F.collect_list(F.struct("__k", "__lo", "__hi", F.col(child).alias("v")))).alias("__c"))
        u = (F.pmod(F.xxhash64("id", F.lit(child), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))).alias("__u")
        x = x.withColumn("__u", u)
        x = x.join(cells, parents) if parents else x.crossJoin(F.broadcast(cells))  # one row
        inside = F.filter("__c", lambda c: F.col("__u") < c["__hi"])
        x = x.withColumn(child, F.coalesce(F.get(inside, F.lit(0))["v"], F.element_at("__c", -1)["v"])).drop("__u", "__c")
    return x


def approximate_posterior(samples: DataFrame, variables: list[str]) -> DataFrame:
    """The variables' values and ``p``: their shares of the samples' weights."""
    s = samples.groupBy(*variables).agg(F.sum("weight").alias("w"))
    return s.select(*variables, (F.col("w") / F.sum("w").over(W.partitionBy())).alias("p"))
