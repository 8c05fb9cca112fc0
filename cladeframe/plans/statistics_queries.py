"""Queries of ranks, moments, fits and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import statistics


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def mid_ranks(spark, sf_dir):
    return statistics.mid_ranks(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"])


def spearman(spark, sf_dir):
    return _r(statistics.spearman(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"))


def pearson_covariance(spark, sf_dir):
    return _r(_t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.covar_samp("l_quantity", "l_discount").alias("cov")))


def mann_whitney(spark, sf_dir):
    return _r(statistics.mann_whitney(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O"), 4)


def chi_square(spark, sf_dir):
    return _r(statistics.chi_square(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"))


def t_tests(spark, sf_dir):
    return _r(statistics.t_tests(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O"))


def ks_two_sample(spark, sf_dir):
    return _r(statistics.ks_two_sample(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "A", "R"))


def z_scores(spark, sf_dir):
    d = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return _r(statistics.z_scores(d, "c_acctbal", ["c_nationkey"]).select("c_custkey", "z"))


def element_quantiles(spark, sf_dir):
    return statistics.element_quantiles(_t(spark, sf_dir, "part"), "p_retailprice", ["p_brand"], 4)


def fits(spark, sf_dir):
    return _r(statistics.fits(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4)


def zero_inflated_gamma(spark, sf_dir):
    return _r(statistics.zero_inflated_gamma(_t(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag"]))


def histogram(spark, sf_dir):
    return _r(statistics.histogram(_t(spark, sf_dir, "part"), "p_retailprice", 900.0, 2100.0, 12))


def empirical_distribution(spark, sf_dir):
    return _r(statistics.empirical_distribution(_t(spark, sf_dir, "part"), "p_size"), 9)


def column_entropy(spark, sf_dir):
    return _r(statistics.column_entropy(_t(spark, sf_dir, "part"), "p_type", ["p_brand"]))


def good_turing_line(spark, sf_dir):
    return _r(statistics.good_turing_line(_t(spark, sf_dir, "lineitem"), "l_partkey"))


def poisson_fit(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return _r(statistics.poisson_log_likelihood(n, "n", ["o_orderstatus"]), 3)


def top_k_per_group(spark, sf_dir):
    from pyspark.sql import Window as W

    d = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return d.withColumn("k", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("k <= 3")


QUERIES = {f.__name__: f for f in (mid_ranks, spearman, pearson_covariance, mann_whitney, chi_square, t_tests, ks_two_sample, z_scores, element_quantiles, fits, zero_inflated_gamma, histogram, empirical_distribution, column_entropy, good_turing_line, poisson_fit, top_k_per_group)}

_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"

ORACLE_SQL = {
    "mid_ranks": "SELECT p_partkey, p_brand, p_size, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2)::DOUBLE AS rank, count(*) OVER (PARTITION BY p_brand, p_size) AS ties FROM part",
    "spearman": f"SELECT round(corr(a, b), 6) AS rho FROM (SELECT {_RANK.format(c='l_quantity')} AS a, {_RANK.format(c='l_discount')} AS b FROM lineitem)",
    "pearson_covariance": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cov FROM lineitem GROUP BY ALL",
    "mann_whitney": f"""
WITH r AS (SELECT o_orderstatus AS g, {_RANK.format(c='o_totalprice')} AS rk, count(*) OVER (PARTITION BY o_totalprice) AS ties FROM orders WHERE o_orderstatus IN ('F', 'O')),
s AS (SELECT count(*) FILTER (g = 'F') AS n_a, count(*) FILTER (g = 'O') AS n_b, sum(rk) FILTER (g = 'F') AS t_a, sum(ties * ties - 1)::DOUBLE AS ties FROM r),
u AS (SELECT *, n_a * n_b + n_a * (n_a + 1) / 2 - t_a AS u, n_a + n_b AS n FROM s)
SELECT n_a, n_b, round(t_a, 4) AS t_a, round(u, 4) AS u, round((abs(u - n_a * n_b / 2) - 0.5) / sqrt(n_a * n_b / 12 * ((n + 1) - ties / (n::DOUBLE * (n - 1)))), 4) AS z FROM u""",
    "chi_square": """
WITH n AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb FROM n),
s AS (SELECT sum(n) * (sum(n * n / (ra * cb)) - 1) AS chi2, sum(n) AS t, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM x)
SELECT round(chi2, 6) AS chi2, ((ka - 1) * (kb - 1))::BIGINT AS dof, round(sqrt(chi2 / (t * least(ka - 1, kb - 1))), 6) AS cramers_v FROM s""",
    "t_tests": """
WITH s AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'O') AS nb, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ma, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mb, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb FROM orders)
SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t, na + nb - 2 AS dof, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS welch_t, round((va / na + vb / nb) ** 2 / (va * va / (na::DOUBLE * na * (na - 1)) + vb * vb / (nb::DOUBLE * nb * (nb - 1))), 6) AS welch_dof, round(greatest(va, vb) / least(va, vb), 6) AS f FROM s""",
    "ks_two_sample": """
WITH n AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)
SELECT round(max(d), 6) AS d FROM (SELECT abs(sum(na) OVER (ORDER BY v) / sum(na) OVER () - sum(nb) OVER (ORDER BY v) / sum(nb) OVER ()) AS d FROM n)""",
    "z_scores": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    "element_quantiles": "SELECT p_brand, k::INT AS k, p_retailprice AS cut FROM (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part), (SELECT unnest([1, 2, 3]) AS k) WHERE i = n * k // 4",
    "fits": """
WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, var_pop(l_extendedprice) AS variance, avg(ln(l_extendedprice)) AS mu, stddev_samp(ln(l_extendedprice)) AS sigma, min(l_extendedprice) AS least FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL),
g AS (SELECT *, (3 - (ln(mean) - mu) + sqrt(((ln(mean) - mu) - 3) ** 2 + 24 * (ln(mean) - mu))) / (12 * (ln(mean) - mu)) AS shape FROM s)
SELECT l_returnflag, n, round(mean, 4) AS mean, round(variance, 4) AS variance, round(1 / mean, 4) AS exp_rate, round(mu, 4) AS lognormal_mu, round(sigma, 4) AS lognormal_sigma, round(shape, 4) AS gamma_shape, round(mean / shape, 4) AS gamma_scale, round(1 + 1 / (mu - ln(least)), 4) AS power_alpha FROM g""",
    "zero_inflated_gamma": "WITH s AS (SELECT l_returnflag, avg((l_discount = 0)::INT) AS zeros, avg(l_discount) FILTER (l_discount > 0) AS m, var_pop(l_discount) FILTER (l_discount > 0) AS v FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(zeros, 6) AS zeros, round(m * m / v, 6) AS shape, round(v / m, 6) AS scale FROM s",
    "histogram": "WITH b AS (SELECT greatest(0, least(11, floor((p_retailprice - 900) / 100)))::BIGINT AS bin FROM part) SELECT bin, round((900 + bin * 100)::DOUBLE, 6) AS lo, round((1000 + bin * 100)::DOUBLE, 6) AS hi, count(*) AS n FROM b GROUP BY ALL",
    "empirical_distribution": "SELECT p_size, round(n / sum(n) OVER (), 9) AS p, round(sum(n) OVER (ORDER BY p_size) / sum(n) OVER (), 9) AS cdf FROM (SELECT p_size, count(*)::DOUBLE AS n FROM part GROUP BY ALL)",
    "column_entropy": "SELECT p_brand, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT p_brand, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS p FROM part GROUP BY p_brand, p_type) GROUP BY ALL",
    "good_turing_line": """
WITH f AS (SELECT r, count(*)::DOUBLE AS nr FROM (SELECT count(*) AS r FROM lineitem GROUP BY l_partkey) GROUP BY ALL), q AS (SELECT r, nr, coalesce(lag(r) OVER (ORDER BY r), 0) AS q, lead(r) OVER (ORDER BY r) AS t FROM f),
z AS (SELECT r, CASE WHEN t IS NOT NULL THEN nr * 2 / (t - q) ELSE nr / (r - q) END AS z FROM q)
SELECT round(regr_slope(ln(z), ln(r)), 6) AS slope, round(regr_intercept(ln(z), ln(r)), 6) AS intercept FROM z""",
    "poisson_fit": "WITH n AS (SELECT o_orderstatus, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey, o_orderstatus), s AS (SELECT o_orderstatus, count(*) AS c, avg(n) AS rate, sum(lgamma(n + 1)) AS lf FROM n GROUP BY ALL) SELECT o_orderstatus, round(rate, 3) AS rate, round(c * rate * (ln(rate) - 1) - lf, 3) AS log_likelihood FROM s",
    "top_k_per_group": "SELECT c_custkey, c_nationkey, c_acctbal, k::INT AS k FROM (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3",
}
