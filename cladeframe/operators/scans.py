"""Running values over rows in order, with no task that holds more than a range of them.

Rows are range partitioned by group and order, so that a hot group lies in many partitions. Each partition is scanned by
itself; what earlier (or later) partitions add to the group that goes on in it is one row a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.plans.session import checkpointed


def scanned(df: DataFrame, on: list[str], order: list[str], **made: tuple[str, Column | str, bool]) -> DataFrame:
    """``df`` with a column for each of ``made``: name = (kind, value, whether the row itself counts).

    Kinds, each over the rows of the same ``on`` values in the order of ``order`` (ascending, nulls first): ``sum`` and ``max`` of the values so
    far (sum: 0 where there are none), ``last``: the last value so far that isn't null, ``next``: the next one that isn't null. Ties in
    ``order`` stand in any order. Null groups are groups of their own.
    """
    with_values = df.withColumns({f"__v_{n}": v if isinstance(v, Column) else F.col(v) for n, (_, v, _) in made.items()})
    parts = checkpointed(with_values.repartitionByRange(*(F.col(c) for c in [*on, *order])).withColumn("__p", F.spark_partition_id()))
    place = F.struct(*order)

    def total(name: str, kind: str) -> Column:
        v = F.col(f"__v_{name}")
        there = F.when(v.isNotNull(), place)
        return {"sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, there), "next": F.min_by(v, there)}[kind].alias(f"__v_{name}")

    def carried(name: str, kind: str) -> Column:
        w = W.partitionBy(*on).orderBy("__p")
        back, ahead = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
        v = F.col(f"__v_{name}")
        return {"sum": lambda: F.sum(v).over(back), "max": lambda: F.max(v).over(back), "last": lambda: F.last(v, ignorenulls=True).over(back), "next": lambda: F.first(v, ignorenulls=True).over(ahead)}[kind]().alias(f"__c_{name}")

    sums = parts.groupBy("__p", *on).agg(*(total(n, k) for n, (k, _, _) in made.items()))
    # Groups that lie in one partition carry nothing; of the others there are at most two rows a partition.
    carry = sums.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*on))).where("__n > 1")
    carry = carry.select(F.col("__p").alias("__cp"), *(F.col(c).alias(f"__on_{c}") for c in on), *(carried(n, k) for n, (k, _, _) in made.items()))
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on), F.col("__p") == F.col("__cp"))
    x = parts.join(F.broadcast(carry), met, "left")
    within = W.partitionBy("__p", *on).orderBy(*order)
    out = {}
    for n, (kind, _, own) in made.items():
        v, c = F.col(f"__v_{n}"), F.col(f"__c_{n}")
        back, ahead = within.rowsBetween(W.unboundedPreceding, 0 if own else -1), within.rowsBetween(0 if own else 1, W.unboundedFollowing)
        if kind == "sum":
            out[n] = F.coalesce(F.sum(v).over(back), F.lit(0)) + F.coalesce(c, F.lit(0))
        elif kind == "max":
            out[n] = F.greatest(F.max(v).over(back), c)
        else:
            out[n] = F.coalesce(F.last(v, ignorenulls=True).over(back) if kind == "last" else F.first(v, ignorenulls=True).over(ahead), c)
    kept = [c for c in df.columns if c not in out]
    return x.withColumns({f"__s_{n}": c for n, c in out.items()}).select(*kept, *(F.col(f"__s_{n}").alias(n) for n in out))
