"""Queries of interval operators: an order's lines as intervals of days from order to shipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import intervals


def _days(c: str):
    return F.datediff(F.to_date(c), F.lit("1992-01-01").cast("date")).cast("long")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_suppkey, l_linenumber, lo, hi: shipping day to that day and as many more as the quantity / 5."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return d.select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), _days("l_shipdate").alias("lo"), (_days("l_shipdate") + F.floor(F.col("l_quantity") / 5)).alias("hi"))


_SPANS = "spans AS (SELECT l_orderkey, l_suppkey, l_linenumber::INT AS l_linenumber, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT AS lo, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + floor(l_quantity / 5))::BIGINT AS hi FROM lineitem)"


def interval_overlap_join(spark, sf_dir):
    """How many pairs of lines of one order intersect, and their mean Jaccard index."""
    s = _spans(spark, sf_dir).select("l_orderkey", "l_linenumber", "lo", "hi")
    j = intervals.overlap_join(s, s, 16, on=["l_orderkey"]).where("l_linenumber < b_l_linenumber")
    return j.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(intervals.jaccard(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi"))), 6).alias("jaccard"))


def interval_union(spark, sf_dir):
    return intervals.merged(_spans(spark, sf_dir), ["l_suppkey"])


def interval_depth_clip(spark, sf_dir):
    return intervals.clipped(_spans(spark, sf_dir), ["l_suppkey"], 3)


def interval_difference(spark, sf_dir):
    """Days of a supplier's lines of number 1 that no line of number 2 covers."""
    s = _spans(spark, sf_dir)
    return intervals.difference(s.where("l_linenumber = 1"), s.where("l_linenumber = 2"), ["l_suppkey"])


def interval_closest(spark, sf_dir):
    """For each first line the closest other line of the order."""
    s = _spans(spark, sf_dir)
    first = s.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = intervals.closest(first, s.where("l_linenumber > 1"), ["l_orderkey"], "l_orderkey")
    return best.withColumn("jaccard", F.round("jaccard", 6))


def nearest_before(spark, sf_dir):
    """The value of a user's last view before each purchase, as a time-ordered window."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    q = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    p = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("v"))
    return intervals.nearest_before(q, p, "ts", "v", ["user_id"]).select("event_id", "user_id", "last_v")


QUERIES = {f.__name__: f for f in (interval_overlap_join, interval_union, interval_depth_clip, interval_difference, interval_closest, nearest_before)}

ORACLE_SQL = {
    "interval_overlap_join": f"""
WITH {_SPANS}
SELECT a.l_linenumber, count(*) AS pairs, round(avg(CASE WHEN (a.hi - a.lo) + (b.hi - b.lo) - greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) > 0
  THEN greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / ((a.hi - a.lo) + (b.hi - b.lo) - greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo))) ELSE 0 END), 6) AS jaccard
FROM spans a JOIN spans b ON a.l_orderkey = b.l_orderkey AND a.lo <= b.hi AND b.lo <= a.hi AND a.l_linenumber < b.l_linenumber GROUP BY ALL""",
    "interval_union": f"""
WITH {_SPANS}, m AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM spans),
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo > prev THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM r GROUP BY l_suppkey, run""",
    "interval_depth_clip": f"""
WITH {_SPANS}, days AS (SELECT l_suppkey, unnest(range(lo, hi + 1)) AS d FROM spans),
c AS (SELECT l_suppkey, d FROM days GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT *, d - row_number() OVER (PARTITION BY l_suppkey ORDER BY d) AS k FROM c)
SELECT l_suppkey, min(d)::BIGINT AS lo, max(d)::BIGINT AS hi FROM g GROUP BY l_suppkey, k""",
    "interval_difference": f"""
WITH {_SPANS}, a AS (SELECT DISTINCT l_suppkey, unnest(range(lo, hi + 1)) AS d FROM spans WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_suppkey, unnest(range(lo, hi + 1)) AS d FROM spans WHERE l_linenumber = 2),
c AS (SELECT * FROM a EXCEPT SELECT * FROM b), g AS (SELECT *, d - row_number() OVER (PARTITION BY l_suppkey ORDER BY d) AS k FROM c)
SELECT l_suppkey, min(d)::BIGINT AS lo, max(d)::BIGINT AS hi FROM g GROUP BY l_suppkey, k""",
    "interval_closest": f"""
WITH {_SPANS}, q AS (SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi FROM spans WHERE l_linenumber = 1 GROUP BY ALL),
x AS (SELECT q.l_orderkey, s.lo AS s_lo, s.hi AS s_hi, greatest(0, q.lo - s.hi, s.lo - q.hi) AS gap, greatest(0, least(q.hi, s.hi) - greatest(q.lo, s.lo)) AS c, (q.hi - q.lo) + (s.hi - s.lo) AS w FROM q JOIN spans s ON q.l_orderkey = s.l_orderkey AND s.l_linenumber > 1),
y AS (SELECT *, CASE WHEN w - c > 0 THEN c / (w - c) ELSE 0 END AS jac FROM x)
SELECT l_orderkey, s_lo, s_hi, gap, round(jac, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY gap, jac DESC, s_lo, s_hi) AS k FROM y) WHERE k = 1""",
    "nearest_before": """
WITH p AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT q.event_id, q.user_id, p.v AS last_v FROM (SELECT * FROM events WHERE event_type = 'purchase') q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.ts >= p.ts""",
}
