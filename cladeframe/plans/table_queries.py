"""Queries of table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import tables


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional_join(spark, sf_dir):
    """Customers by balance beside orders by price, place by place."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return tables.positional_join(c, o, ["c_acctbal", "c_custkey"], ["o_totalprice", "o_orderkey"]).select("c_custkey", "o_orderkey")


def transposed(spark, sf_dir):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    d = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.min("n_name").alias("first"), F.max("n_name").alias("last"), F.count(F.lit(1)).alias("n"))
    return tables.transposed(d, "r_name", ["first", "last", "n"], names)


def distinct_cells(spark, sf_dir):
    return tables.distinct_cells(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def column_types(spark, sf_dir):
    return tables.all_of_type(_t(spark, sf_dir, "part"), ["p_name", "p_size", "p_retailprice"], "double")


def flattened(spark, sf_dir):
    """Days as samples, event types as items, count and total as features."""
    e = _t(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    long = e.unpivot(["day", "event_type"], ["n", "total"], "feature", "v")
    return tables.flattened(long, "day", "event_type", "feature", "v", [(i, f) for i in ("view", "click", "purchase") for f in ("n", "total")])


def colour_bins(spark, sf_dir):
    d = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return tables.colour_bins(d, "c_acctbal", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark, sf_dir):
    d = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return tables.stratified_sample(d, "c_mktsegment", "c_custkey", 0.1)


def kernel_density(spark, sf_dir):
    d = tables.kernel_density(_t(spark, sf_dir, "part"), "p_retailprice", [900.0 + 100 * i for i in range(13)])
    return d.withColumn("density", F.round("density", 9))


def kendall(spark, sf_dir):
    d = tables.kendall(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber")
    return d.withColumn("tau", F.round("tau", 6))


QUERIES = {f.__name__: f for f in (positional_join, transposed, distinct_cells, column_types, flattened, colour_bins, stratified_sample, kernel_density, kendall)}

_N = "min(n_name) AS first, max(n_name) AS last, count(*)::VARCHAR AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
ORACLE_SQL = {
    "positional_join": "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) USING (i)",
    "transposed": "WITH d AS (SELECT r_name, " + _N + ") " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"max({c}) FILTER (r_name = '{r}') AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM d" for c in ("first", "last", "n")),
    "distinct_cells": "SELECT l_returnflag AS cell FROM lineitem UNION SELECT l_linestatus FROM lineitem UNION SELECT l_linenumber::VARCHAR FROM lineitem",
    "column_types": "SELECT 'p_name' AS \"column\", bool_and(try_cast(p_name AS DOUBLE) IS NOT NULL) AS fits FROM part UNION ALL SELECT 'p_size', true UNION ALL SELECT 'p_retailprice', true",
    "flattened": "SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"CASE WHEN count(*) FILTER (event_type = '{i}') > 0 THEN (count(*) FILTER (event_type = '{i}'))::DOUBLE END AS {i}__n, round(sum(value) FILTER (event_type = '{i}'), 4) AS {i}__total" for i in ("view", "click", "purchase")) + " FROM events GROUP BY ALL",
    "colour_bins": "WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) SELECT least(10, floor((c_acctbal - a) / (b - a) * 10) + 1)::INT AS bin, count(*) AS n FROM customer, s GROUP BY ALL",
    "stratified_sample": "SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0' || c_custkey), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE k <= ceil(n * 0.1)",
    "kernel_density": "WITH s AS (SELECT 1.06 * least(stddev_samp(p_retailprice), (quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM part), g AS (SELECT (900 + 100 * unnest(range(13)))::DOUBLE AS x) SELECT x, round(avg(exp(-((p_retailprice - x) ** 2) / (2 * h * h)) / (h * sqrt(2 * pi()))), 9) AS density FROM part, s, g GROUP BY x",
    "kendall": """
WITH n AS (SELECT l_quantity AS x, l_linenumber AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
s AS (SELECT sum(sign(b.y - a.y) * a.n * b.n) AS s FROM n a JOIN n b ON a.x < b.x), t AS (SELECT sum(n) AS t FROM n),
tx AS (SELECT sum(m * (m - 1) / 2) AS tx FROM (SELECT sum(n) AS m FROM n GROUP BY x)), ty AS (SELECT sum(m * (m - 1) / 2) AS ty FROM (SELECT sum(n) AS m FROM n GROUP BY y))
SELECT round(s / sqrt((t * (t - 1) / 2 - tx) * (t * (t - 1) / 2 - ty)), 6) AS tau FROM s, t, tx, ty""",
}
