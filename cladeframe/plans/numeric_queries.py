"""Queries of vector, sequence and special functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import sequences as S
from cladeframe.functions import special
from cladeframe.functions import vectors as V


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_functions(spark, sf_dir):
    """Norms, extremes and order statistics of every embedding."""
    x = F.col("x")
    d = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    q = V.quartiles(x)
    r = lambda c: F.round(c, 6)
    return d.select("vec_id", r(V.norm1(x)).alias("norm1"), r(V.norm2(x)).alias("norm2"), r(V.norm_inf(x)).alias("norm_inf"), r(V.mean(x)).alias("mean"), r(V.deviation(x)).alias("sd"), V.which_min(x).alias("which_min"), V.which_max(x).alias("which_max"), r(V.median(x)).alias("median"), r(q["q1"]).alias("q1"), r(q["q3"]).alias("q3"), r(V.log_sum_exp(x)).alias("lse"))


def softmax_entropy(spark, sf_dir):
    d = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("p", V.softmax(F.col("x")))
    u = F.array_repeat(F.lit(1.0), F.size("p"))
    flat = F.transform(u, lambda v: v / F.size("p"))
    return d.select("vec_id", F.round(V.entropy(F.col("p")), 6).alias("entropy"), F.round(V.kl_divergence(F.col("p"), flat), 6).alias("kl"), F.round(V.js_divergence(F.col("p"), flat), 6).alias("js"))


def class_centroids(spark, sf_dir):
    """Distance and cosine of every embedding to the mean of its label."""
    d = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    c = d.groupBy("label", "i").agg(F.avg("v").alias("m"))
    j = d.join(c, ["label", "i"]).groupBy("vec_id").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("d"), (F.sum(F.col("v") * F.col("m")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("m") * F.col("m")))).alias("c"))
    return j.select("vec_id", F.round("d", 6).alias("distance"), F.round("c", 6).alias("cosine"))


def kmer_counts(spark, sf_dir):
    """Counts and keys of the 3-letter words over A C G T in part names, letters outside left out."""
    d = _t(spark, sf_dir, "part").select(F.regexp_replace(F.upper("p_name"), "[^ACGT]", "").alias("s"))
    k = d.select(F.explode(S.kmers(F.col("s"), 3)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return k.select("word", S.word_key(F.col("word"), S.DNA).alias("key"), S.key_word(S.word_key(F.col("word"), S.DNA), 3, S.DNA).alias("again"), "n")


def composite_keys(spark, sf_dir):
    """Mixed-radix index of (flag, status, line number) and back."""
    d = _t(spark, sf_dir, "lineitem")
    values = [F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1, F.instr(F.lit("FO"), F.col("l_linestatus")) - 1, F.col("l_linenumber") - 1]
    x = d.select(S.mixed_radix(values, [3, 2, 8]).alias("key"))
    a, b, c = S.from_mixed_radix(F.col("key"), [3, 2, 8])
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", a.alias("flag"), b.alias("status"), c.alias("line"), "n")


def text_functions(spark, sf_dir):
    d = _t(spark, sf_dir, "part")
    return d.select("p_partkey", S.file_name(F.col("p_name")).alias("file"), S.ordinal(F.col("p_partkey")).alias("ordinal"), F.element_at(S.tokens(F.col("p_type"), " "), -1).alias("last"), S.interval_label(F.col("p_size"), F.col("p_size") + 5).alias("label"), S.merged_range(F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string"))).cast("double").alias("middle"), F.round(V.round_half_up(-F.col("p_retailprice"), 1), 1).alias("rounded"), S.width_thresholds(F.col("p_size"), [10, 20, 30, 40]).alias("bin"))


def special_functions(spark, sf_dir):
    d = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"))
    return d.select("p_partkey", F.round(special.lgamma_col(F.col("x") + 0.5), 6).alias("lgamma"), F.round(special.normal_cdf(F.col("x"), F.lit(2.0), F.lit(1.5)), 6).alias("normal"), F.round(special.poisson_cdf(F.lit(3.0), F.col("x") + 0.1), 6).alias("poisson"), F.round(special.gamma_cdf(F.col("x"), F.lit(1.0), F.lit(2.0)), 6).alias("exponential"), F.round(special.beta_col(F.lit(2.0), F.lit(3.0), F.least(F.lit(1.0), F.col("x") / 6)), 6).alias("beta23"))


def json_values(spark, sf_dir):
    """Typed values out of the events' JSON properties."""
    e = _t(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


QUERIES = {f.__name__: f for f in (vector_functions, softmax_entropy, class_centroids, kmer_counts, composite_keys, text_functions, special_functions, json_values)}

_X = "x AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
_P = "e AS (SELECT vec_id, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p, 1.0::DOUBLE / count(*) OVER (PARTITION BY vec_id) AS q FROM (SELECT vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM x))"

ORACLE_SQL = {
    "special_functions": """
WITH p AS (SELECT p_partkey, p_size / 10 AS x FROM part), z AS (SELECT DISTINCT x, (x - 2) / 1.5 / sqrt(2) AS z, x + 0.1 AS l, least(1, x / 6) AS b FROM p),
e AS (SELECT x, 0.5 + sum((CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * pow(z, 2 * i + 1) / exp(lgamma(i + 1)) / (2 * i + 1)) / sqrt(pi()) AS normal FROM z, range(60) t(i) GROUP BY x)
SELECT p_partkey, round(lgamma(x + 0.5), 6) AS lgamma, round(normal, 6) AS normal, round(exp(-l) * (1 + l + l * l / 2 + l * l * l / 6), 6) AS poisson, round(1 - exp(-x / 2), 6) AS exponential,
round(6 * b * b - 8 * b * b * b + 3 * b * b * b * b, 6) AS beta23 FROM p JOIN z USING (x) JOIN e USING (x)""",
    "vector_functions": f"""
WITH {_X} SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(v))), 6) AS norm1, round(sqrt(list_dot_product(x, x)), 6) AS norm2, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS norm_inf,
round(list_avg(x), 6) AS mean, round(list_stddev_samp(x), 6) AS sd, (list_position(x, list_min(x)) - 1)::BIGINT AS which_min, (list_position(x, list_max(x)) - 1)::BIGINT AS which_max,
round(list_sort(x)[len(x) // 2 + 1], 6) AS median, round(list_sort(x)[len(x) // 4 + 1], 6) AS q1, round(list_sort(x)[len(x) * 3 // 4 + 1], 6) AS q3, round(ln(list_sum(list_transform(x, lambda v: exp(v)))), 6) AS lse FROM x""",
    "softmax_entropy": f"""
WITH {_X}, {_P} SELECT vec_id, round(-sum(p * ln(p)), 6) AS entropy, round(sum(p * ln(p / q)), 6) AS kl, round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 6) AS js FROM e GROUP BY ALL""",
    "class_centroids": f"""
WITH {_X}, v AS (SELECT vec_id, label, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM x), m AS (SELECT *, avg(v) OVER (PARTITION BY label, i) AS m FROM v)
SELECT vec_id, round(sqrt(sum((v - m) ** 2)), 6) AS distance, round(sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 6) AS cosine FROM m GROUP BY ALL""",
    "kmer_counts": """
WITH s AS (SELECT regexp_replace(upper(p_name), '[^ACGT]', '', 'g') AS s FROM part), k AS (SELECT substr(s, i, 3) AS word FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM s))
SELECT word, ((instr('ACGT', word[1]) - 1) + 4 * (instr('ACGT', word[2]) - 1) + 16 * (instr('ACGT', word[3]) - 1))::BIGINT AS key, word AS again, count(*) AS n FROM k GROUP BY ALL""",
    "composite_keys": "WITH x AS (SELECT instr('ANR', l_returnflag) - 1 AS a, instr('FO', l_linestatus) - 1 AS b, l_linenumber - 1 AS c FROM lineitem) SELECT ((a * 2 + b) * 8 + c)::BIGINT AS key, a::BIGINT AS flag, b::BIGINT AS status, c::BIGINT AS line, count(*) AS n FROM x GROUP BY ALL",
    "text_functions": """
SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') AS file,
p_partkey::VARCHAR || CASE WHEN p_partkey % 100 IN (11, 12, 13) THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
string_split(p_type, ' ')[-1] AS last, '[' || p_size || ', ' || (p_size + 5) || ']' AS label, (p_size + 1.5)::DOUBLE AS middle, round(floor(-p_retailprice * 10 + 0.5) / 10, 1) AS rounded,
CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 2 WHEN p_size <= 40 THEN 3 ELSE 4 END AS bin FROM part""",
    "json_values": "WITH e AS (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM e GROUP BY ALL",
}
