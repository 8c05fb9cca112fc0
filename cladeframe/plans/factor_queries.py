"""Queries of factor algebra and network parameters over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import factors, learning, statistics


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def factor_product(spark, sf_dir):
    """Counts by (flag, status) times quantity sums by (status, line number), joined on the status."""
    d = _lines(spark, sf_dir)
    x = factors.from_counts(d, ["l_returnflag", "l_linestatus"])
    y = factors.from_counts(d, ["l_linestatus", "l_linenumber"], F.col("l_quantity"))
    return _rounded(factors.product(x, y), "lp")


def factor_marginal(spark, sf_dir):
    d = factors.from_counts(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return _rounded(factors.marginal(d, ["l_linenumber"]), "lp")


def factor_maximum(spark, sf_dir):
    """The most frequent (flag, status) of each line number."""
    d = factors.from_counts(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return _rounded(factors.maximum(d, ["l_linenumber"]), "lp")


def factor_normalised(spark, sf_dir):
    return _rounded(factors.normalised(factors.from_counts(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus"])), "lp")


def factor_evidence(spark, sf_dir):
    d = factors.from_counts(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return _rounded(factors.evidence(d, {"l_returnflag": "R"}), "lp")


def factor_posterior(spark, sf_dir):
    """P(status of an order | its customer's segment BUILDING) in the network segment -> priority -> status, the priority eliminated."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = o.join(c, "o_custkey")
    seg = factors.from_counts(j, ["c_mktsegment"])
    pri = statistics.conditional_probabilities(j, "o_orderpriority", ["c_mktsegment"]).select("c_mktsegment", "o_orderpriority", F.log("p").alias("lp"))
    sta = statistics.conditional_probabilities(o, "o_orderstatus", ["o_orderpriority"]).select("o_orderpriority", "o_orderstatus", F.log("p").alias("lp"))
    return _rounded(factors.posterior([seg, pri, sta], ["o_orderpriority"], {"c_mktsegment": "BUILDING"}), "p")


def mutual_information(spark, sf_dir):
    return _rounded(factors.mutual_information(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus", "l_linenumber"]), "mi")


def cpt_mle(spark, sf_dir):
    return _rounded(statistics.conditional_probabilities(_t(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderpriority"]), "p")


def cpt_pseudo_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return _rounded(statistics.smoothed_probabilities(e, "event_type", ["hour"], 0.5), "p")


def gaussian_node_pooled(spark, sf_dir):
    return _rounded(statistics.gaussian_node(_t(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], tied="pooled"), "mean", "variance")


def joint_probability(spark, sf_dir):
    return _rounded(factors.normalised(factors.from_counts(_t(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])).select("c_mktsegment", "c_nationkey", F.exp("lp").alias("p")), "p", digits=9)


def noisy_or(spark, sf_dir):
    """Chance that a line causes trouble: returned, discounted or late, each with its own chance."""
    d = _t(spark, sf_dir, "lineitem")
    p = learning.noisy_or([F.col("l_returnflag") == "R", F.col("l_discount") > 0.05, F.col("l_linestatus") == "O"], [0.4, 0.2, 0.1], 0.01)
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(p), 6).alias("p"))


def markov_transitions(spark, sf_dir):
    """P(next event type | type) over all users' sequences."""
    from pyspark.sql import Window as W

    e = _t(spark, sf_dir, "events")
    nxt = e.select("event_type", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_type")).where("next_type IS NOT NULL")
    return _rounded(statistics.conditional_probabilities(nxt, "next_type", ["event_type"]), "p")


QUERIES = {f.__name__: f for f in (factor_product, factor_marginal, factor_maximum, factor_normalised, factor_evidence, factor_posterior, mutual_information, cpt_mle, cpt_pseudo_counts, gaussian_node_pooled, joint_probability, noisy_or, markov_transitions)}

_PAIR = "SELECT '{a}' AS var_a, '{b}' AS var_b, round(sum(nab / t * log2(nab * t / (na * nb))), 6) AS mi FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS nab FROM lineitem GROUP BY ALL) JOIN (SELECT {a} AS a, count(*)::DOUBLE AS na FROM lineitem GROUP BY ALL) USING (a) JOIN (SELECT {b} AS b, count(*)::DOUBLE AS nb FROM lineitem GROUP BY ALL) USING (b), (SELECT count(*)::DOUBLE AS t FROM lineitem)"

ORACLE_SQL = {
    "factor_product": "SELECT l_linestatus, l_returnflag, l_linenumber::INT AS l_linenumber, round(ln(n) + ln(q), 6) AS lp FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL) JOIN (SELECT l_linestatus, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) USING (l_linestatus)",
    "factor_marginal": "SELECT l_linenumber::INT AS l_linenumber, round(ln(count(*)), 6) AS lp FROM lineitem GROUP BY ALL",
    "factor_maximum": "SELECT l_linenumber::INT AS l_linenumber, round(ln(n), 6) AS lp, l_returnflag AS best_l_returnflag, l_linestatus AS best_l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY n DESC, l_returnflag, l_linestatus) AS k FROM (SELECT l_linenumber, l_returnflag, l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)) WHERE k = 1",
    "factor_normalised": "SELECT l_returnflag, l_linestatus, round(ln(n / sum(n) OVER ()), 6) AS lp FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)",
    "factor_evidence": "SELECT l_linestatus, l_linenumber::INT AS l_linenumber, round(ln(count(*)), 6) AS lp FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL",
    "factor_posterior": """
WITH j AS (SELECT o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'),
p AS (SELECT o_orderpriority, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM j GROUP BY o_orderpriority),
s AS (SELECT o_orderpriority, o_orderstatus, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS q FROM orders GROUP BY o_orderpriority, o_orderstatus)
SELECT o_orderstatus, round(sum(p * q), 6) AS p FROM p JOIN s USING (o_orderpriority) GROUP BY ALL""",
    "mutual_information": " UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"))),
    "cpt_mle": "SELECT o_orderpriority, o_orderstatus, count(*)::DOUBLE AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS p FROM orders GROUP BY o_orderpriority, o_orderstatus",
    "cpt_pseudo_counts": """
WITH n AS (SELECT hour(ts)::INT AS hour, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
f AS (SELECT h.hour, t.event_type, coalesce(n.n, 0) + 0.5 AS n FROM (SELECT DISTINCT hour FROM n) h CROSS JOIN (SELECT DISTINCT event_type FROM n) t LEFT JOIN n ON n.hour = h.hour AND n.event_type = t.event_type)
SELECT hour, event_type, n::DOUBLE AS n, round((n / sum(n) OVER (PARTITION BY hour))::DOUBLE, 6) AS p FROM f""",
    "gaussian_node_pooled": "SELECT l_returnflag, l_linestatus, n, round(mean, 6) AS mean, round(greatest(sum((n - 1) * v) OVER () / sum(n - 1) OVER (), 0.001), 6) AS variance FROM (SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, avg(l_quantity) AS mean, var_pop(l_quantity) AS v FROM lineitem GROUP BY ALL)",
    "joint_probability": "SELECT c_mktsegment, c_nationkey, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS p FROM customer GROUP BY ALL",
    "noisy_or": "SELECT l_returnflag, l_linestatus, round(avg(1 - 0.99::DOUBLE * CASE WHEN l_returnflag = 'R' THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN l_discount > 0.05 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN l_linestatus = 'O' THEN 0.9::DOUBLE ELSE 1 END), 6) AS p FROM lineitem GROUP BY ALL",
    "markov_transitions": "WITH x AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) SELECT event_type, next_type, count(*)::DOUBLE AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS p FROM x WHERE next_type IS NOT NULL GROUP BY event_type, next_type",
}
