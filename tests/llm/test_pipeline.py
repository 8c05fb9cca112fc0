"""The pipeline on the smallest tables, each stage against a brute-force version on its own input; and SQL of the package's queries."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cladeframe.llm import bpe, queries
from test_llm_operators import _components, _targets, docs

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, SF).write.parquet(str(tmp_path / str(k)))
        seen.append(d)
        d = spark.read.parquet(str(tmp_path / str(k)))
    seen.append(d)
    rows = [x.collect() for x in seen]
    assert seen[1].columns == seen[2].columns == seen[3].columns == seen[0].columns
    kept = {r.doc_id for r in rows[1]}
    good = [r.doc_id for r in rows[0] if labels.get(r.doc_id) == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert {r.doc_id for r in rows[2]} == {i for i, _, c, k in _components([(r.doc_id, r.text) for r in rows[1]], 80) if k}
    sizes: dict = {}
    for r in rows[2]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    largest = max(len((r.text or "").split()) for r in rows[2])
    for s, target in _targets(sizes).items():
        assert abs(sum(len((r.text or "").split()) for r in rows[3] if r.source == s) - target) <= largest
    enc = bpe.encoding(corpus_pipeline.RANK_FILE, public_tokenizers.PATTERN)
    lengths = sorted((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in rows[3])
    assert sorted((r.doc_id, r.n_tokens) for r in rows[4]) == lengths and all(r.round_trip for r in rows[4])


def test_queries_with_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF).toPandas()
        want = c.execute(sql).df()[list(got.columns)]
        key = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
        assert key(got) == key(want), name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert os.path.exists(corpus_pipeline.RANK_FILE)


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def _types(df):
    return dict(df.dtypes)


def test_query_of_minhash_is_brute_force(spark):
    got = queries.QUERIES["op1_minhash_dedup"](spark, SF)
    assert {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}.items() <= _types(got).items()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == _components([(r.doc_id, r.text) for r in _docs(spark)], 85)


def test_query_of_suffix_tree_counts_by_brute_force(spark):
    got = queries.QUERIES["op2_suffix_tree_scores"](spark, SF)
    assert {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}.items() <= _types(got).items()
    rows = _docs(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [w.translate(LOWER) for w in re.findall("[^\\x20\\x09-\\x0D]+", t or "")] + [None]
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = {r.doc_id: (held(r.doc_id), len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r.text))) for r in rows}
    found = {r.doc_id: r for r in got.collect()}
    assert set(found) == set(want)
    for i, (h, k, known, total, base) in want.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, k, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


LOWER = {ord(a): ord(a.lower()) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def test_query_of_bpe_is_tiktoken(spark):
    enc = bpe.encoding(corpus_pipeline.RANK_FILE, public_tokenizers.PATTERN)
    want = set()
    for r in _docs(spark):
        ids = enc.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op4_byte_bpe"](spark, SF).collect()} == want


def test_query_of_quality_rejects_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_quality_classifier"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for q in (0, 1):
        own = [r.kept for r in rows if labels.get(r.doc_id) == q]
        assert sum(k == bool(q) for k in own) >= 0.95 * len(own) > 0


def test_query_of_neighbours_is_near_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    found: dict = {}
    for r in queries.QUERIES["op7_multiprobe_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == sorted(ids[ids % 100 == 0].tolist())
    hits = 0
    for q, own in found.items():
        dist = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = {i for i in ids[np.lexsort((ids, dist))] if i != q and len(ids)}
        assert own == sorted(own, key=lambda p: (p[1], p[0])) and all(abs(dist[ids == v][0] - s) < 1e-12 for v, s in own) and q not in dict(own)
        hits += len(set(dict(own)) & set([i for i in ids[np.lexsort((ids, dist))].tolist() if i != q][:10]))
        assert best
    assert hits >= 0.9 * 10 * len(found)


def test_query_of_shards(spark):
    rows, docs = queries.QUERIES["op8_histogram_shards"](spark, SF).collect(), _docs(spark)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(24):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r.size for r in own) - total / 24) <= 0.001 * total / 24 + 2 * most


def test_query_of_matroska(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_matroska"](spark, SF).collect()}
    for r in _docs(spark):
        raw = (r.text or "").encode()
        whole = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:])) and g.media_bytes > len(whole) and g.feature


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
    assert Counter((r.doc_id, r.source, r.n_tokens, bytes(r.ids), r.round_trip) for r in got) == Counter((r.doc_id, r.source, r.n_tokens, bytes(r.ids), r.round_trip) for r in d.collect())


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, no rows."""
    d = docs(spark)
    for c in ("kept", "size", "taken", "rest", "cut", "component", "n", "quality", "path", "text_hash"):
        d = d.withColumn(c, F.lit(c))
    for given in (d, d.limit(0)):
        x = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            y = stage(spark, x, SF)
            assert y.columns == x.columns, name
            rows = y.collect()
            assert {(r.doc_id, r.text, r.n, r.cut) for r in rows} <= {(r.doc_id, r.text, r.n, r.cut) for r in x.collect()}
            assert len(rows) or given is not d, name
            x = spark.createDataFrame(rows, y.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, x, SF).collect()
        assert len(last) == x.count() and all(r.round_trip for r in last)
