"""Queries of whole networks: most probable explanations, EM with unknown values, learned noisy-or, networks with Gaussian variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import mixed_networks as mixed
from cladeframe.operators import networks, statistics

ROUNDS = 2


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _family(d: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """P(child given parents) as the rows have it."""
    p = statistics.conditional_probabilities(d, child, parents)
    return p.select(*parents, child, F.log("p").alias("lp"))


def most_probable_explanation(spark, sf_dir):
    """The most probable return flag and line number of a chain flag - status - number, the status summed out; flag and status where a line is the third of its order."""
    d = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    chain = [_family(d, "l_returnflag", []), _family(d, "l_linestatus", ["l_returnflag"]), _family(d, "l_linenumber", ["l_linestatus"])]
    one = networks.explanation(chain, ["l_returnflag", "l_linenumber"], ["l_linestatus"]).select(F.lit("mixed").alias("question"), "l_returnflag", F.lit(None).cast("string").alias("l_linestatus"), "l_linenumber", "lp")
    two = networks.explanation(chain, ["l_returnflag", "l_linestatus"], known={"l_linenumber": 3}).select(F.lit("known").alias("question"), "l_returnflag", "l_linestatus", F.lit(3).alias("l_linenumber"), "lp")
    return one.unionByName(two).withColumn("lp", F.round("lp", 6))


def _unknowns(spark, sf_dir):
    """Lines whose flag or status is unknown for some orders; their class never is known."""
    d = _t(spark, sf_dir, "lineitem")
    return d.select(F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")).alias("flag"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linestatus")).alias("status"), F.col("l_linenumber").cast("int").alias("number"))


def network_em(spark, sf_dir):
    """Tables of a network with a hidden class of lines after two rounds of EM."""
    rows = _unknowns(spark, sf_dir)
    first = lambda v, k: [(h, x, 1 + (i + h) % k) for h in (0, 1) for i, x in enumerate(v)]
    flags, states, numbers = (sorted(r[0] for r in rows.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in ("flag", "status", "number"))  # a handful each
    tables = {"class": spark.createDataFrame([(0, 0.6), (1, 0.4)], "class int, p double").select("class", F.log("p").alias("lp"))}
    for child, kind, start in (("flag", "string", first(flags, 3)), ("status", "string", first(states, 2)), ("number", "int", first(numbers, 7))):
        t = spark.createDataFrame(start, f"class int, {child} {kind}, w int")
        tables[child] = t.select("class", child, F.log(F.col("w") / sum(w for h, _, w in start if h == 0)).alias("lp"))
    found, seen = networks.learn(rows, tables, ROUNDS)
    out = [found[c].select(F.lit(c).alias("family"), "class", (F.lit("") if c == "class" else F.col(c).cast("string")).alias("value"), F.round(F.exp("lp"), 6).alias("p")) for c in ("class", "flag", "status", "number")]
    told = spark.createDataFrame([(f"likelihood before round {k + 1}", None, "", round(x, 3)) for k, x in enumerate(seen)], "family string, class int, value string, p double")
    return reduce(DataFrame.unionByName, [*out, told])


def noisy_or_fit(spark, sf_dir):
    """How far urgency and being open make an order costly: two rounds of EM."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.col("o_orderstatus") == "O").alias("open"), (F.col("o_totalprice") > 150_000).alias("costly"))
    leak, strengths, seen = networks.learn_noisy_or(o, "costly", ["urgent", "open"], ROUNDS)
    return spark.createDataFrame([(round(leak, 6), round(strengths[0], 6), round(strengths[1], 6), round(seen[-1], 3))], "leak double, urgent double, open double, likelihood double")


def _customers(spark, sf_dir):
    """Each customer's segment, nation, balance (x, in thousands) and mean order price (y, in hundred thousands)."""
    y = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.avg("o_totalprice") / 100_000).alias("y"))
    return _t(spark, sf_dir, "customer").join(y, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("segment"), "c_nationkey", (F.col("c_acctbal") / 1000).alias("x"), "y")


def _mixed(spark, sf_dir):
    """segment, balance by segment, mean price by segment along the balance; and each nation's mean price as evidence."""
    d = _customers(spark, sf_dir)
    s = d.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.var_pop("x").alias("vx"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    b = F.col("c") / F.col("vx")
    total = s.agg(F.sum("n").alias("t"))
    prior = s.crossJoin(F.broadcast(total)).select("segment", F.log(F.col("n") / F.col("t")).alias("lp"))  # one row
    x = mixed.gaussian(s.select("segment", F.col("mx").alias("mean"), F.col("vx").alias("variance")), "x")
    y = mixed.gaussian(s.select("segment", (F.col("my") - b * F.col("mx")).alias("mean"), (F.col("vy") - b * F.col("c")).alias("variance"), F.array(b).alias("slopes")), "y", ("x",))
    seen = d.groupBy("c_nationkey").agg(F.avg("y").alias("seen"))
    return mixed.observed_rows(mixed.product(mixed.product(mixed.from_discrete(prior), x), y), seen, "c_nationkey", {"y": "seen"})


def mixed_posterior(spark, sf_dir):
    """The chance of each segment given a nation's mean price, the balance integrated out."""
    return mixed.posterior(_mixed(spark, sf_dir), "segment", ["c_nationkey"]).withColumn("p", F.round("p", 6))


def mixed_moments(spark, sf_dir):
    """Mean and variance of the balance given a nation's mean price, of the mixture over segments."""
    m = mixed.summed(_mixed(spark, sf_dir), ["c_nationkey"])
    return m.select("c_nationkey", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("cov")[0], 6).alias("variance"), F.round("lp", 6).alias("lp"))


QUERIES = {f.__name__: f for f in (most_probable_explanation, network_em, noisy_or_fit, mixed_posterior, mixed_moments)}

_CHAIN = """l AS (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber::INT AS n FROM lineitem), pf AS (SELECT f, count(*) / sum(count(*)) OVER () AS p FROM l GROUP BY f),
ps AS (SELECT f, s, count(*) / sum(count(*)) OVER (PARTITION BY f) AS p FROM l GROUP BY f, s), pn AS (SELECT s, n, count(*) / sum(count(*)) OVER (PARTITION BY s) AS p FROM l GROUP BY s, n),
j AS (SELECT pf.f, ps.s, pn.n, pf.p * ps.p * pn.p AS p FROM pf JOIN ps USING (f) JOIN pn USING (s))"""


def _em_sql() -> str:
    out = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS flag, CASE WHEN l_orderkey % 7 <> 0 THEN l_linestatus END AS status, l_linenumber::INT AS number, count(*) AS n FROM lineitem GROUP BY ALL))",
        "hs AS (SELECT unnest([0, 1]) AS class)",
        "h0 AS (SELECT class, CASE class WHEN 0 THEN 0.6::DOUBLE ELSE 0.4 END AS p FROM hs)",
    ]
    for c, k, total in (("flag", 3, 6), ("status", 2, 3), ("number", 7, 28)):
        out.append(f"{c}0 AS MATERIALIZED (SELECT class, v AS {c}, (1 + (i + class) % {k}) / {total}::DOUBLE AS p FROM hs, (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {c} AS v FROM d WHERE {c} IS NOT NULL)))")
    for k in range(ROUNDS):
        out.append(f"w{k} AS MATERIALIZED (SELECT d.*, h.class, h.p * coalesce(f.p, 1) * coalesce(s.p, 1) * m.p AS w FROM d CROSS JOIN h{k} h LEFT JOIN flag{k} f ON f.class = h.class AND f.flag = d.flag LEFT JOIN status{k} s ON s.class = h.class AND s.status = d.status JOIN number{k} m ON m.class = h.class AND m.number = d.number)")
        out.append(f"q{k} AS MATERIALIZED (SELECT *, n * w / sum(w) OVER (PARTITION BY r) AS e FROM w{k})")
        out.append(f"ll{k} AS (SELECT sum(n * ln(t)) AS ll FROM (SELECT r, any_value(n) AS n, sum(w) AS t FROM w{k} GROUP BY r))")
        out.append(f"h{k + 1} AS (SELECT class, sum(e) / sum(sum(e)) OVER () AS p FROM q{k} GROUP BY class)")
        for c in ("flag", "status", "number"):
            out.append(f"{c}{k + 1} AS MATERIALIZED (SELECT class, {c}, sum(e) / sum(sum(e)) OVER (PARTITION BY class) AS p FROM (SELECT class, {c}, e FROM q{k} WHERE {c} IS NOT NULL UNION ALL SELECT q.class, t.{c}, q.e * t.p FROM q{k} q JOIN {c}{k} t ON t.class = q.class WHERE q.{c} IS NULL) GROUP BY class, {c})")
    parts = [f"SELECT 'class' AS family, class, '' AS value, round(p, 6) AS p FROM h{ROUNDS}"]
    parts += [f"SELECT '{c}', class, {c}::VARCHAR, round(p, 6) FROM {c}{ROUNDS}" for c in ("flag", "status", "number")]
    parts += [f"SELECT 'likelihood before round {k + 1}', NULL, '', round(ll, 3) FROM ll{k}" for k in range(ROUNDS)]
    return "WITH " + ",\n".join(out) + "\n" + " UNION ALL ".join(parts)


def _noisy_sql() -> str:
    out = ["d AS (SELECT o_orderpriority = '1-URGENT' AS x, o_orderstatus = 'O' AS y, o_totalprice > 150000 AS z, count(*) AS n FROM orders GROUP BY ALL)", "s0 AS (SELECT 0.1::DOUBLE AS l, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b)"]
    for k in range(ROUNDS):
        out.append(f"f{k} AS (SELECT d.*, s.*, (1 - l) * CASE WHEN x THEN 1 - a ELSE 1 END * CASE WHEN y THEN 1 - b ELSE 1 END AS q FROM d, s{k} s)")
        out.append(f"s{k + 1} AS (SELECT sum(CASE WHEN z THEN n * l / (1 - q) ELSE 0 END) / sum(n) AS l, sum(CASE WHEN x AND z THEN n * a / (1 - q) ELSE 0 END) / sum(n) FILTER (x) AS a, sum(CASE WHEN y AND z THEN n * b / (1 - q) ELSE 0 END) / sum(n) FILTER (y) AS b FROM f{k})")
    return "WITH " + ", ".join(out) + f" SELECT round(l, 6) AS leak, round(a, 6) AS urgent, round(b, 6) AS open, (SELECT round(sum(n * ln(CASE WHEN z THEN 1 - q ELSE q END)), 3) FROM f{ROUNDS - 1}) AS likelihood FROM s{ROUNDS}"


_BALANCE = """y AS (SELECT o_custkey, avg(o_totalprice) / 100000 AS y FROM orders GROUP BY o_custkey), d AS (SELECT c_mktsegment AS segment, c_nationkey, c_acctbal / 1000 AS x, y FROM customer JOIN y ON c_custkey = o_custkey),
s AS (SELECT segment, count(*) / sum(count(*)) OVER () AS p, avg(x) AS mx, var_pop(x) AS vx, avg(y) AS my, var_pop(y) AS vy, covar_pop(x, y) AS c FROM d GROUP BY segment), e AS (SELECT c_nationkey, avg(y) AS seen FROM d GROUP BY c_nationkey),
w AS (SELECT c_nationkey, segment, p * exp(-pow(seen - my, 2) / (2 * vy)) / sqrt(2 * pi() * vy) AS w, mx + c / vy * (seen - my) AS m, vx - c * c / vy AS v FROM s, e)"""

ORACLE_SQL = {
    "most_probable_explanation": f"""WITH {_CHAIN}, a AS (SELECT f, n, sum(p) AS p FROM j GROUP BY f, n), b AS (SELECT f, s, p FROM j WHERE n = 3)
SELECT * FROM (SELECT 'mixed' AS question, f AS l_returnflag, NULL::VARCHAR AS l_linestatus, n AS l_linenumber, round(ln(p), 6) AS lp FROM a ORDER BY p DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'known', f, s, 3, round(ln(p), 6) FROM b ORDER BY p DESC LIMIT 1)""",
    "network_em": _em_sql(),
    "noisy_or_fit": _noisy_sql(),
    "mixed_posterior": f"WITH {_BALANCE} SELECT c_nationkey, segment, round(w / sum(w) OVER (PARTITION BY c_nationkey), 6) AS p FROM w",
    "mixed_moments": f"WITH {_BALANCE}, m AS (SELECT c_nationkey, sum(w) AS t, sum(w * m) / sum(w) AS mean, sum(w * (v + m * m)) / sum(w) AS sq FROM w GROUP BY c_nationkey) SELECT c_nationkey, round(mean, 6) AS mean, round(sq - mean * mean, 6) AS variance, round(ln(t), 6) AS lp FROM m",
}
