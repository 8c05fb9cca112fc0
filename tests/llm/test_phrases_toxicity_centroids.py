"""Centroid clustering, toxicity and collocations against plain Python; awkward rows; long white space; clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import bpe, centroids, collocations, matroska, minhash, queries, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_sort_means", "op13_collocations"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(queries.ORACLE_SQL[name]).df())


# --- centroids

def _clustered(vectors, k, rounds, scale):
    """Lloyd's rounds over whole numbers, every distance taken. ``vectors``: (id, components)."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v in vectors]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [near(v) for _, v in kept]
    total = Counter()
    for d, j in found:
        total[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    every = [d for d, _ in found]
    return sorted(((i, j, fits(d), fits(total[j]) if all(x < 1 << 63 for (x, y) in found if y == j) else None, fits(sum(every)) if all(x < 1 << 63 for x in every) else None, sha[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


@pytest.mark.parametrize("large", [False, True])
def test_sort_means_on_awkward_vectors(spark, large):
    r = random.Random(8)
    good = [(i, [r.choice([-1.5, 0.25, 0.25, 2.0, r.random()]) for _ in range(3)]) for i in range(60)]
    good += [(5, good[5][1]), (5, [9.0, 9.0, 9.0]), (None, [0.0, 0.0, -0.01])]
    if large:
        good += [(100, [1e300, -1.0, 0.0]), (101, [3e9, 3e9, 3e9]), (102, [-(2.0**60), 1.0, 0.5])]
    bad = [(70, None), (71, [1.0, None, 2.0]), (72, [1.0, float("nan"), 2.0]), (73, [1.0, float("inf"), 2.0]), (74, [1.0, 2.0]), (75, []), (76, [1.0] * 4)]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, prev int, distance string").repartition(3)
    got = sorted(map(tuple, centroids.cluster(d, k=5, rounds=3, dims=3, scale=64).collect()), key=str)
    assert got == _clustered(good, 5, 3, 64)
    assert centroids.cluster(d.limit(0), dims=3).count() == 0
    few = d.where("vec_id IN (1, 2)")
    assert sorted(map(tuple, centroids.cluster(few, k=5, rounds=2, dims=3).collect()), key=str) == _clustered([x for x in good if x[0] in (1, 2)], 5, 2, 64)


def test_scan_from_any_previous_centroid_finds_the_nearest():
    rng = np.random.default_rng(3)
    cents = rng.integers(-20, 20, (16, 4)).tolist()
    cents[9] = cents[2]  # a tie between centroids
    x = rng.integers(-25, 25, (500, 4))
    d = ((x[:, None, :] - np.array(cents)[None]) ** 2).sum(axis=2)
    scan = centroids.Scan(cents)
    for prev in (0, 7, 9):
        best, near = scan.assigned(x, np.full(500, prev))
        assert (best == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()
        assert [scan.assigned_one(v, prev) for v in x[:50].tolist()] == list(zip(best[:50].tolist(), near[:50].tolist()))


# --- toxicity

def test_slope_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 2, 1, 4])
    sizes = rng.integers(1, 4, counts.sum())
    features = rng.integers(0, 6, sizes.sum())
    toxic, at = np.array([1, 1, 0, 0, 1]), rng.normal(size=8)
    f = lambda z: toxicity.gradient(toxic, features, sizes, counts, z[:6], z[6], z[7])
    slope = f(at)[1:]
    for i in range(8):
        step = np.eye(8)[i] * 1e-6
        assert (f(at + step)[0] - f(at - step)[0]) / 2e-6 == pytest.approx(slope[i], abs=1e-5)


def _toxic_table(spark, n=400):
    r = random.Random(4)
    words = ["ba" + "".join(r.choice("aeioulmnrst") for _ in range(4)) for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        said = [" ".join(r.choice(words) for _ in range(8)) for _ in range(6)]
        if toxic:
            said[i % 6] += " " + r.choice(["vilka", "vilkor", "vilken", "Vilk!"])
        docs.append((i, ". ".join(said)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_offending_sentences_are_learnt_from_documents_labels(spark):
    docs, labels = _toxic_table(spark)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = toxicity.training_rows(d, lab, "doc_id", "text", "toxic")
    model, seen = toxicity.fit(train, toxicity.selected(train))
    assert seen[-1] > seen[0] and set(b[:3] for b in model.weights) == {"vil"}
    text, truth = dict(docs), dict(labels)
    for r in toxicity.classify(d, lab).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) == truth[r.doc_id]
        assert all("vilk" in text[r.doc_id][p["start"] : p["stop"]].lower() for p in r.offending) and len(r.offending) == truth[r.doc_id]


def test_toxicity_of_awkward_rows(spark):
    docs, labels = _toxic_table(spark)
    odd = [(None, "vilka"), (1000, None), (1001, ""), (1002, "..."), (1003, "VILKA"), (1003, "VILKA"), (1004, "ok " * 200_000 + "vilkor"), (1005, "vilken. " * 50)]
    d = spark.createDataFrame([(i, t, 1.0, "u") for i, t in docs + odd], "doc_id long, text string, score double, predicted string")
    lab = spark.createDataFrame([*labels, (None, 1), (1, None), (0, 0), (5000, 1)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.classify(d, lab).collect():
        got.setdefault(r.doc_id, []).append(r)
    leak = got[1001][0].score
    assert got[1000][0].score == got[1002][0].score == leak < 0.2 and len(got[1003]) == 2 and got[None][0].held_out is None
    assert all(got[i][0].predicted == 1 for i in (None, 1003, 1004, 1005)) and len(got[1005][0].offending) == 50
    assert got[1004][0].offending[0]["stop"] == len("ok " * 200_000 + "vilkor")
    none = toxicity.classify(d, lab.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0] and toxicity.classify(d.limit(0), lab).count() == 0


def test_held_out_documents_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_toxic_sentences"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "toxic").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.85 and max(neg) < 0.5


# --- collocations

def _phrases(docs, least, longest, percent, top):
    n, f = Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), a)
        found = []
        for p, a in good.items():
            if p in inside and 100 * inside[p] >= percent * a:
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block,longest", [(12 << 20, 3), (300, 3), (300, 4)])
def test_phrases_in_blocks_of_any_size(spark, monkeypatch, block, longest):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "SHARD_BYTES", block)  # as many shards as blocks
    r = random.Random(11)
    kinds = ["Alpha", "beta", "GAMMA", "d\xe9lta", "\xc9PSILON", "zeta", "a", " x"]
    docs = [(r.choice(["en", "de", None]), "".join(r.choice(kinds) + r.choice([" ", " ", "  ", "\t", ". ", "\n", "! "]) for _ in range(r.randrange(60)))) for _ in range(80)]
    docs += [("en", None), ("de", ""), ("fr", " .,; \n"), (None, "beta zeta " * 40), ("en", "alpha beta gamma " * 2000), ("und", "beta zeta")] + [("en", "one two three four")] * 12
    d = spark.createDataFrame([(x, t, 1, 2, 3) for x, t in docs], "lang string, text string, block int, level int, rank int").repartition(4)
    got = sorted(map(tuple, collocations.collocations(d, longest=longest, top=40).collect()))
    assert got == _phrases(docs, 10, longest, 50, 40)
    assert collocations.collocations(d.limit(0)).count() == 0 and collocations.collocations(d.where("lang = 'fr'")).count() == 0


def test_counts_beyond_64_bits_stay_exact(spark):
    big = spark.createDataFrame([(5_000_000_000, 5_000_000_001, 5_000_000_003)], "a long, l long, r long")
    num = (F.lit(1_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)")) * F.col("a").cast("decimal(15,0)")
    got = big.withColumn("num", num).withColumn("den", F.col("l").cast("decimal(15,0)") * F.col("r").cast("decimal(15,0)")).select(F.expr("num div den").alias("s")).first().s
    assert got == 1_000_000 * 5_000_000_000**2 // (5_000_000_001 * 5_000_000_003)


# --- long white space; callers' columns of any name

@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 2_000_000 + "b", "x\t" + "\n" * 3_000_000, "y" + "\t 　" * 400_000 + "z", "\n" * 5_000 + "don't" + " " * 5_000, "w" * 3_000_000])
def test_long_runs_are_encoded_by_the_merge_rules(text):
    import public_tokenizers

    ids = bpe.encode_text(text, queries.RANK_FILE, public_tokenizers.PATTERN)
    assert bpe.decode_ids(ids, queries.RANK_FILE) == text.encode()
    enc = bpe.encoding(queries.RANK_FILE, public_tokenizers.PATTERN)
    want: list[int] = []
    at = 0
    for m in re.finditer(r"\s+", text):
        want += enc.encode(text[at : m.start()], disallowed_special=()) if m.start() > at else []
        stop = m.end() if m.end() == len(text) or len(m.group()) == 1 else m.end() - 1
        at = m.start() if len(m.group()) == 1 and m.end() < len(text) else stop
        want += enc._encode_single_piece(text[m.start() : at]) if at > m.start() else []
    want += enc.encode(text[at:], disallowed_special=()) if at < len(text) else []
    assert np.frombuffer(ids, "<u4").tolist() == want


def test_columns_of_any_name_come_through(spark):
    names = ["__h", "h", "c0", "c1", "__data", "__m", "value", "__id", "__th", "component", "hashes"]
    d = spark.createDataFrame([(i, "one two three four five six " * (1 + i % 2), *range(len(names))) for i in range(6)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = minhash.deduplicated(d).collect()
    assert [tuple(r)[2:] for r in kept] == [tuple(range(len(names)))] * len(kept) and minhash.deduplicated(d).columns == d.columns and len(kept) < 6
    stored = matroska.payload_features(matroska.demux(matroska.mux(d, "text")))
    for r in stored.collect():
        assert [r[n] for n in names] == list(range(len(names)))
        size = len("one two three four five six ") * (1 + r.doc_id % 2)
        data = r.text.encode() + b"\xff" * (-size % 576)
        s = np.frombuffer(data, np.uint8)
        rms = math.sqrt(np.mean((s.astype(float) - 128) ** 2))
        parts = dict(p.split("=") for p in r.feature.split(";"))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert parts["mean"] == f"{s.mean():.6f}" and parts["rms"] == f"{rms:.6f}" and int(parts["sign_changes"]) == np.count_nonzero(np.diff((s > 127).astype(int))) and int(parts["packets"]) == len(r.packets)
