"""Queries of mixtures chosen by BIC, priors of tables and sampled networks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import gibbs, mixtures
from cladeframe.plans.network_queries import _CHAIN, _family

KINDS = [("gaussian", 1), ("gaussian", 2), ("gaussian", 3), ("gamma", 1), ("gamma", 2), ("exponential", 1), ("exponential", 2)]
ROUNDS = 3
PRIOR = [(0.6, {"F": 8.0, "O": 1.0, "P": 1.0}), (0.3, {"F": 1.0, "O": 8.0, "P": 1.0}), (0.1, {"F": 2.0, "O": 2.0, "P": 2.0})]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_mixtures(spark, sf_dir):
    """Mixtures of three families fitted to orders' prices (in ten thousands) at once, and the one of least BIC."""
    o = _t(spark, sf_dir, "orders").select((F.round("o_totalprice", -2) / 10_000).alias("x"))
    t = mixtures.fit_table(spark, mixtures.fit_all(o, "x", KINDS, ROUNDS))
    return t.withColumns({c: F.round(c, 5) for c in ("weight", "first", "second")} | {c: F.round(c, 3) for c in ("log_likelihood", "bic")})


def balance_posterior(spark, sf_dir):
    """Mean balance by nation after a normal prior."""
    c = _t(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("b"))
    p = mixtures.gaussian_mean_posterior(c, "b", ["c_nationkey"], 4000.0, 250_000.0, 9_000_000.0)
    return p.withColumns({k: F.round(k, 4) for k in ("mean", "variance")})


def order_rate_posterior(spark, sf_dir):
    """Orders a customer of each segment, after a gamma prior."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))
    return mixtures.gamma_rate_posterior(c, "n", ["c_mktsegment"], 2.0, 0.5).withColumn("mean", F.round("mean", 6))


def status_posterior(spark, sf_dir):
    """The shares of orders' states by customer, after a mixture of Dirichlet priors."""
    n = _t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return mixtures.dirichlet_mixture_posterior(n, ["o_custkey"], "o_orderstatus", "n", [w for w, _ in PRIOR], [a for _, a in PRIOR]).withColumn("p", F.round("p", 9))


def sampled_status(spark, sf_dir):
    """The distribution of a line's status given its number in the chain flag - status - number, by blanket sampling, to one digit."""
    d = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    chain = [_family(d, "l_returnflag", []), _family(d, "l_linestatus", ["l_returnflag"]), _family(d, "l_linenumber", ["l_linestatus"])]
    drawn = gibbs.samples(spark, chain, chains=400, discard=20, keep=50, known={"l_linenumber": 3}, seed=7)
    return gibbs.posterior(drawn, ["l_linestatus"]).withColumn("p", F.round("p", 1))


QUERIES = {f.__name__: f for f in (price_mixtures, balance_posterior, order_rate_posterior, status_posterior, sampled_status)}


def _mixture_sql() -> str:
    floor, least = f"{mixtures.FLOOR}::DOUBLE", "1e-300::DOUBLE"
    kinds = ", ".join(f"('{f}', {k}, {i})" for f, k in KINDS for i in range(k))
    free = "CASE family WHEN 'exponential' THEN 1 ELSE 2 END"
    out = [
        "d AS MATERIALIZED (SELECT x, count(*)::DOUBLE AS n, ln(x) AS lx FROM (SELECT round(o_totalprice, -2) / 10000 AS x FROM orders) WHERE x > 0 GROUP BY x)",
        "st AS (SELECT min(x) AS lo, max(x) AS hi, sum(n) AS t, greatest(sum(n * x * x) / sum(n) - pow(sum(n * x) / sum(n), 2), 0.000001) AS v FROM d)",
        f"kd(family, components, component) AS (VALUES {kinds})",
        f"c0 AS (SELECT family, components, component, 1.0::DOUBLE / components AS w, CASE family WHEN 'gaussian' THEN m WHEN 'gamma' THEN m * m / v ELSE 1 / m END AS a, CASE family WHEN 'gaussian' THEN v WHEN 'gamma' THEN v / m ELSE 0 END AS b FROM (SELECT kd.*, v, lo + (hi - lo) * (component + 0.5) / components AS m FROM kd, st))",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"l{r} AS (SELECT family, components, component, x, lx, n, ln(w) + CASE family WHEN 'gaussian' THEN -(x - a) * (x - a) / (2 * b) - 0.5 * ln(2 * pi() * b) WHEN 'gamma' THEN (a - 1) * lx - x / b - (a * ln(b) + lgamma(a)) ELSE ln(a) - a * x END AS l FROM d, c{r})")
        out.append(f"t{r} AS (SELECT *, max(l) OVER (PARTITION BY family, components, x) AS top FROM l{r})")
        out.append(f"z{r} AS MATERIALIZED (SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY family, components, x)) AS z FROM t{r})")
        if r < ROUNDS:
            out.append(f"s{r} AS (SELECT family, components, component, sum(n * exp(l - z)) AS r, sum(n * exp(l - z) * x) AS sx, sum(n * exp(l - z) * x * x) AS sxx, sum(n * exp(l - z) * lx) AS sl FROM z{r} GROUP BY ALL)")
            out.append(f"g{r} AS (SELECT *, sx / r AS m, greatest({floor}, ln(sx / r) - sl / r) AS s FROM s{r})")
            out.append(f"h{r} AS (SELECT *, (3 - s + sqrt(pow(s - 3, 2) + 24 * s)) / (12 * s) AS shape FROM g{r})")
            out.append(f"c{r + 1} AS (SELECT family, components, component, r / t AS w, CASE family WHEN 'gaussian' THEN m WHEN 'gamma' THEN shape ELSE 1 / greatest(m, {least}) END AS a, CASE family WHEN 'gaussian' THEN greatest({floor}, sxx / r - m * m) WHEN 'gamma' THEN m / shape ELSE 0 END AS b FROM h{r}, st)")
    out.append(f"ll AS (SELECT family, components, sum(n * z) AS ll FROM z{ROUNDS} WHERE component = 0 GROUP BY ALL)")
    out.append(f"bi AS (SELECT *, (components * ({free} + 1) - 1) * ln(t) - 2 * ll AS bic FROM ll, st)")
    return "WITH " + ",\n".join(out) + f"\nSELECT c.family, c.components, component, round(w, 5) AS weight, round(a, 5) AS first, round(b, 5) AS second, round(ll, 3) AS log_likelihood, round(bic, 3) AS bic, bic = (SELECT min(bic) FROM bi) AS chosen FROM c{ROUNDS} c JOIN bi USING (family, components)"


def _dirichlet_sql() -> str:
    total = {k: sum(a.values()) for k, (_, a) in enumerate(PRIOR)}
    lp = [f"{math.log(w)} + lgamma({total[k]}) - lgamma(f + o + p + {total[k]}) + " + " + ".join(f"lgamma({c} + {a[v]}) - lgamma({a[v]})" for v, c in (("F", "f"), ("O", "o"), ("P", "p"))) for k, (w, a) in enumerate(PRIOR)]
    share = [f"exp(l{k} - greatest(l0, l1, l2))" for k in range(3)]
    each = " UNION ALL ".join(f"SELECT o_custkey, '{v}' AS o_orderstatus, round((" + " + ".join(f"{share[k]} * ({c} + {PRIOR[k][1][v]}) / (f + o + p + {total[k]})" for k in range(3)) + f") / ({' + '.join(share)}), 9) AS p FROM s" for v, c in (("F", "f"), ("O", "o"), ("P", "p")))
    return f"WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS f, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS o, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS p FROM orders GROUP BY o_custkey), s AS (SELECT *, {', '.join(f'{x} AS l{k}' for k, x in enumerate(lp))} FROM g) {each}"


ORACLE_SQL = {
    "price_mixtures": _mixture_sql(),
    "balance_posterior": "WITH g AS (SELECT c_nationkey, count(*) FILTER (c_custkey % 4 <> 0) AS n, coalesce(sum(c_acctbal) FILTER (c_custkey % 4 <> 0), 0) AS s FROM customer GROUP BY c_nationkey) SELECT c_nationkey, n, round((4000 / 250000 + s / 9000000) / (1 / 250000 + n / 9000000), 4) AS mean, round(1 / (1 / 250000 + n / 9000000), 4) AS variance FROM g",
    "order_rate_posterior": "WITH c AS (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT c_mktsegment, 2.0::DOUBLE + sum(n)::DOUBLE AS shape, 0.5::DOUBLE + count(*)::DOUBLE AS rate, round((2.0::DOUBLE + sum(n)::DOUBLE) / (0.5::DOUBLE + count(*)::DOUBLE), 6) AS mean FROM c GROUP BY c_mktsegment",
    "status_posterior": _dirichlet_sql(),
    "sampled_status": f"WITH {_CHAIN}, x AS (SELECT s, sum(p) AS p FROM j WHERE n = 3 GROUP BY s) SELECT s AS l_linestatus, round(p / sum(p) OVER (), 1) AS p FROM x",
}
