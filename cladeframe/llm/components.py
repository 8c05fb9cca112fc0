"""Connected components by alternating large-star and small-star, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import checkpointed


#: Up to so many links (16 bytes each) the grouped minima are broadcast to them; beyond, they are joined by shuffle.
BROADCAST_LINKS = 500_000
_ROWS_EACH = 250_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``links``.

    Links are undirected; loops and repeated links do no harm, links with a null end are left out. Each round
    is two joins with grouped minima: no node's links are gathered anywhere, a hub's are summed before
    the shuffle and split by adaptive execution in the join. Rounds grow with the logarithm of the
    number of nodes; each is cut off by a reliable checkpoint. No round has more links than there are links and nodes at first.
    """
    one, two = F.col(a), F.col(b)
    edges = links.where(one.isNotNull() & two.isNotNull() & (one != two)).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct()
    edges, was = checkpointed(edges, _ROWS_EACH), None
    side = F.broadcast if edges.count() <= BROADCAST_LINKS else lambda df: df
    while True:
        # Large star: each node links its larger neighbours to the least of itself and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node links itself and its smaller neighbours to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(low), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # Every node has a link to its least neighbour, so the row that is that link stands for the node's own.
        edges = checkpointed(small.distinct(), _ROWS_EACH)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
