"""The operators on small tables that hold what is awkward: nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import bpe, chat, licenses, matroska, minhash, mixing, neighbours, quality, sharding, suffix_tree
from cladeframe.llm.components import connected_components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(200))


def docs(spark):
    texts = [BASE, BASE, BASE.replace("w50 ", "x "), "", None, "   ", "one two", "ONE two", LONG, LONG + " tail", "été <|endoftext|> \U0001f600\x00\x0b."]
    rows = [(i, t, None if i % 4 == 3 else "en", None if i % 5 == 4 else f"src{i % 3}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, BASE, "en", "src0", 1), rows[0], rows[4]], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_is_tiktoken_and_round_trips(spark):
    d = docs(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for chunk in (50, bpe.CHUNK):
        out = bpe.decode(bpe.encode(d, RANKS, public_tokenizers.PATTERN, chunk=chunk), RANKS)
        rows = out.withColumn("n", bpe.unpacked(F.col("ids"))).collect()
        assert len(rows) == 14
        for r in rows:
            want = enc.encode_ordinary(r.text or "")
            assert np.frombuffer(r.ids, "<u4").tolist() == want and bytes(r.decoded) == (r.text or "").encode()
            if len(want) < 3000:
                assert r.n == want
        key = lambda df: sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in df.collect())
        assert key(bpe.round_tripped(d, RANKS, public_tokenizers.PATTERN, chunk=chunk)) == key(out)
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(KeyError):
        bpe.decode_ids(np.array([2**31], "<u4").tobytes(), RANKS)


@pytest.mark.parametrize("text", ["a  b   c\n\n d", "x" * 300 + " y" * 50, " " * 200, "don't  stop's 123 4, !! \t\t z" * 9])
def test_bpe_pieces_are_safe(text):
    whole = bpe.encode_text(text, RANKS, public_tokenizers.PATTERN)
    for chunk in (1, 3, 7, 20):
        assert "".join(bpe.safe_pieces(text, chunk)) == text
        assert bpe.encode_text(text, RANKS, public_tokenizers.PATTERN, chunk) == whole


def _components(rows, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    group = {k: k for k in range(len(sets))}

    def root(k):
        return k if group[k] == k else root(group[k])

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x[0] is not None and y[0] is not None and x[1] and y[1] and 100 * len(x[1] & y[1]) >= percent * len(x[1] | y[1]):
                group[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root(j) == root(k) and sets[j][0] is not None]
        c = None if i is None else min(ids)
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_is_brute_force(spark, percent):
    rng = np.random.default_rng(percent)
    texts = []
    for _ in range(12):
        base = [f"t{v}" for v in rng.integers(0, 5000, 60)]
        for _ in range(6):
            v = list(base)
            for k in rng.integers(0, 60, rng.integers(0, 3)):
                v[k] = "edit"
            texts.append(" ".join(v))
    shared = [f"s{v}" for v in range(80)]
    texts += [" ".join(shared + [f"u{i}_{k}" for k in range(12 + i % 3)]) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (100, "another text"), (101, "another text"), (None, texts[0])]
    d = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(None if i is None else i + 50, t) for i, t in rows], "doc_id long, text string"))
    got = minhash.near_duplicates(d.withColumn("component", F.lit("clash")).withColumn("n", F.lit(0)), percent)
    want = _components([(r.doc_id, r.text) for r in d.collect()], percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == want


def test_deduplicated_keeps_one_of_each_group(spark):
    d = docs(spark)
    kept = minhash.deduplicated(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 3, 4, 4, 5, 6, 8, 10, None], key=str)
    assert minhash.deduplicated(empty(spark)).count() == 0 and minhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_tree_base_and_probabilities(spark):
    d = docs(spark)
    rows = suffix_tree.score(d).collect()
    train = [(r.doc_id, r.text) for r in d.collect() if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10]
    counts: dict = {}
    for _, t in train:
        for w in [*(t or "").encode().lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), len(w := [*(r.text or "").encode().lower().split(), None]), sum(x in counts for x in w), round(sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for r in d.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    again = suffix_tree.score(d.withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("text_hash", F.lit("x")), piece=20_000).collect()
    assert np.allclose(sorted(r.score for r in rows), sorted(r.score for r in again))
    assert suffix_tree.score(empty(spark)).count() == 0


@pytest.mark.parametrize("piece", [suffix_tree.PIECE, 40, 14])
def test_suffix_tree_scores_are_brute_force(spark, monkeypatch, piece):
    """The tree in dictionaries, grown and read context by context; in one piece and in many, with early flushes."""
    monkeypatch.setattr(suffix_tree, "HELD", 50)
    monkeypatch.setattr(suffix_tree, "_SLICE", 400)
    rng = np.random.default_rng(3)
    nouns = ["cat", "dog", "bird", "tree", "été"]
    rows = [(i, " ".join(f"The {nouns[int(rng.integers(0, 5))]} sat by a {nouns[int(rng.integers(0, 3))]}" for _ in range(int(rng.integers(1, 6))))) for i in range(60)] + [(100, None), (101, ""), (None, "The cat"), (3, "The owl"), (3, "The owl")]
    depth, min_count, min_next, min_gain = 4, 6, 2, 2.0
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, min_count=min_count, min_next=min_next, min_gain=min_gain, piece=piece).collect()

    def symbols(t):
        return [suffix_tree.START] * depth + list(b" ".join((t or "").encode().lower().split())) + [suffix_tree.END]

    n: dict = {}
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            x = symbols(t)
            for k in range(depth, len(x)):
                for d in range(depth + 1):
                    c = n.setdefault(tuple(x[k - d : k]), {})
                    c[x[k]] = c.get(x[k], 0) + 1
    kept: dict = {}

    def value(ctx, sym):
        if ctx and (len(ctx) and kept.get(ctx) is None):
            return value(ctx[1:], sym)
        entries, rest = kept[ctx]
        return entries[sym] if sym in entries else rest * (value(ctx[1:], sym) if ctx else 1 / 256)

    for ctx in sorted(n, key=len):
        c, total = n[ctx], sum(n[ctx].values())
        if ctx and total < min_count:
            continue
        q = {s: value(ctx[1:], s) if ctx else 1 / 256 for s in c}
        p = {s: (c[s] + len(c) * q[s]) / (total + len(c)) for s in c}
        if ctx and sum(c[s] * math.log(p[s] / q[s]) for s in c) < min_gain:
            continue
        own = {s for s in c if c[s] >= min_next or not ctx}
        out = sum(q[s] for s in own)
        kept[ctx] = {s: p[s] for s in own}, (1 - sum(p[s] for s in own)) / (1 - out) if out < 1 - 1e-12 else 0.0
    assert sum(len(k) > 2 for k in kept) > 10

    def score(t):
        x = symbols(t)
        return sum(math.log10(value(tuple(x[k - depth : k]), x[k])) for k in range(depth, len(x)))

    want = sorted((str(i), round(score(t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_suffix_tree_distributions_sum_to_one(spark):
    d = spark.createDataFrame([("the cat sat on the mat " * 20,), ("a dog ran at the cat " * 20,)], "text string")
    tree = suffix_tree._collected(suffix_tree.grown(suffix_tree.window_counts(d), min_count=4, min_next=2, min_gain=1.0), suffix_tree.DEPTH)
    for context in (b"\xfe" * suffix_tree.DEPTH, b" the ", b"zzzzz", b"e cat"):
        c = int.from_bytes(context, "big")
        assert abs((10 ** tree.log10(np.array([c << 8 | s for s in range(256)]))).sum() - 1) < 1e-9
    assert any(len(level[2]) for level in tree.levels[3:])


def test_licenses(spark):
    text = "Intro\nReleased under the MIT License.\nLicensed under the Apache License Version 2.0\nthe mit of it\n\nThis is free and unencumbered\nsoftware released into the public domain.\n"
    d = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (1, text, "x"), (4, "MIT", "w")], "doc_id long, text string, license_matches string")
    out = {(r.doc_id, tuple((m.license, round(m.dice, 3)) for m in r.license_matches)) for r in licenses.scan(d).collect()}
    assert out == {(1, (("MIT", 1.0), ("Apache-2.0", 1.0), ("Unlicense", 1.0))), (2, ()), (3, ()), (4, ())}
    assert licenses.scan(d).count() == 5 and licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(d, templates=[]).where("size(license_matches) > 0").count() == 0
    for n in range(1, 40):
        low, high = licenses.size_bounds(n, 0.8)
        fits = [m for m in range(1, 90) if 2 * min(m, n) / (m + n) >= 0.8 - 1e-12]
        assert (low, high) == (min(fits), max(fits))


def test_licenses_beside_other_words(spark):
    mit = next(t for i, t in licenses.MORE_TEMPLATES if i == "MIT" and len(t) > 500)
    w = mit.split(" ")
    lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
    block = "/*\n * MIT License\n *\n" + "\n *\n".join(" * " + x for x in lines) + "\n */\nint main() { return 0; }"
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version. See the file.\nimport os"
    texts = ["This project is licensed under the MIT License.", "Copyright (c) 2020 Jane Doe. Licensed under the MIT License.", "MIT License", block, gpl, "x\nParts are licensed under the MIT\nLicense, others under CC: licensed under CC BY 4.0 only.\nReleased under the MIT License\n", "the license of the software under the apache and the mit of it"]
    out = {r.i: [(m.passage, m.license, round(m.dice, 2)) for m in r.license_matches] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    one = ("licensed under the mit license", "MIT", 1.0)
    assert out[0] == [one] and out[1] == [one] and out[2] == [("mit license", "MIT", 1.0)] and out[6] == []
    assert [m[1] for m in out[3]] == ["MIT", "MIT"] and out[3][0][0] == "mit license" and out[3][1][2] >= 0.98
    assert [m[1:] for m in out[4]] == [("GPL-2.0", 0.94)]  # the paragraph as a whole
    assert out[5] == [("released under the mit license", "MIT", 1.0), one, ("licensed under cc by 4 0", "CC-BY-4.0", 1.0)]


def test_license_windows_are_the_best_of_all(spark):
    import random

    rng = random.Random(1)
    t = "a b c d e f g h"
    grams = set(licenses.template_bigrams(t))
    texts = [" ".join(rng.choice("abcdefghx") if rng.random() < 0.3 else "abcdefgh"[i % 8] for i in range(rng.randint(2, 40))) for _ in range(60)]
    got = {r.i: max((m.dice for m in r.license_matches), default=0) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), templates=[("T", t)]).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        g = [f"{x} {y}" for x, y in zip(w, w[1:])]
        best = max((2 * len(grams & set(g[a:b])) / (len(set(g[a:b])) + len(grams)) for a in range(len(g)) for b in range(a + 1, min(len(g), a + 10) + 1)), default=0)
        assert (got[i] > 0) == (best >= 0.8)


def _targets(sizes):
    """Water filling by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        each = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if each[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return full | each
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_mixing(spark):
    d = docs(spark).withColumn("size", F.lit("clash"))
    rows = mixing.mix(d).collect()
    sizes: dict = {}
    for r in rows:
        assert r.size == len((r.text or "").split())
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = _targets(sizes)
    for s, n in sizes.items():
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == n and 0 <= r.taken <= 2 * r.size for r in mine)
        assert sum(r.taken for r in mine) == math.floor(mine[0].target)
    key = lambda rs: sorted((str(r.doc_id), str(r.text), r.taken) for r in rs)
    assert key(mixing.mix(d).collect()) == key(rows)
    whole = mixing.mix(d, cut="documents")
    assert whole.where("taken % greatest(cast(size as long), 1) <> 0").count() == 0
    assert mixing.repeated(whole).count() == sum(r.taken // r.size for r in whole.collect() if r.size)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    d = docs(spark)
    for c in ("rest", "cut", "times", "key", "range", "place", "extra", "c0", "__size", "turn"):
        d = d.withColumn(c, F.lit(c))
    out = mixing.mix(d)
    assert out.columns == [*d.columns, "size", "source_size", "target", "taken"]
    assert {tuple(r[c] for c in d.columns[5:]) for r in out.collect()} == {tuple(d.columns[5:])}
    again = mixing.repeated(mixing.mix(d, cut="documents"))
    assert again.columns == d.columns and again.count() > 0


def test_mixing_cuts_within_a_run_of_equal_keys(spark):
    """A third of all rows have no id and one text: one key, in which the cut lies."""
    d = spark.range(0, 300, 1, 3).selectExpr("CAST(NULL AS long) AS doc_id", "'one two three' AS text", "'a' AS source").unionByName(spark.range(100).selectExpr("id AS doc_id", "'x y' AS text", "'b' AS source"))
    rows = mixing.mix(d).collect()
    want = _targets({"a": 900, "b": 200})
    for s in "ab":
        assert sum(r.taken for r in rows if r.source == s) == math.floor(want[s])
    many = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 as int)) AS text", "concat('s', id % 400) AS source")
    sizes: dict = {}
    for r in many.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want = _targets(sizes)
    assert {r.source: round(r.target, 6) for r in mixing.mix(many).collect()} == {k: round(v, 6) for k, v in want.items()}


def test_quality(spark):
    good = [(i, " ".join(f"plain{(i * 7 + k) % 501}" for k in range(60)) + ".", "en", f"s{i % 3}", None) for i in range(90)]
    bad = [(1000 + i, "BUY!! NOW!! " * 30 + "$$$ ### %%%", "en", "s0", None) for i in range(30)]
    d = spark.createDataFrame(good + bad + [(5000, None, None, None, None), (5001, "", None, "s1", None), (5002, "Short text.", "en", None, None), good[0]], DOCS).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 2)] + [(1000 + i, 0, 0) for i in range(0, 30, 2)] + [(None, 1, 0), (3, None, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(d, labels).collect()
    assert len(rows) == d.count() and {r.kept for r in rows if r.doc_id < 1000 or r.doc_id >= 5000} == {True} and {r.kept for r in rows if 1000 <= r.doc_id < 5000} == {False}
    none = quality.classify(d, labels.limit(0)).collect()
    assert all(r.kept for r in none)
    assert quality.classify(empty(spark), labels).count() == 0


def test_quality_is_brute_force(spark):
    """Evidence from counts in dictionaries, priors and posteriors from plain sums; fluent junk that only its words tell."""
    rng = np.random.default_rng(12)
    word = lambda junk: f"cheap{int(rng.integers(0, 6))}" if junk and rng.random() < 0.2 else f"plain{int(rng.integers(0, 40))}"
    rows = [(i, " ".join(word(i % 4 == 0) for _ in range(60)), ["en", "de", None][i % 3], f"s{i % 5}" if i % 7 else None) for i in range(1000)] + [(9000, None, "en", "s1"), (9001, "", "en", "s1"), (9002, LONG * 4, "en", "s2"), (3, "plain1 plain2 plain3", "en", "s3")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("evidence", F.lit("clash")).withColumn("n", F.lit("kept")).withColumn("c0", F.lit("kept"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 1000) if i % 2 or i % 8 == 0], "doc_id long, quality int")
    known = {r.doc_id: r.quality for r in labels.collect()}
    labelled = [(t, known[i]) for i, t, *_ in rows if i in known]
    n = [sum(1 for _, g in labelled if g == k) for k in (0, 1)]

    def grams(text):
        b, _ = quality.buckets(pa.array([text], pa.string()))
        return set(b.tolist())

    def shape(text):
        return quality.binned(quality.features(pa.array([text], pa.string())))[0]

    seen, bins = [{}, {}], [{}, {}]
    for t, g in labelled:
        for b in grams(t):
            seen[g][b] = seen[g].get(b, 0) + 1
        for k, b in enumerate(shape(t)):
            bins[g][k, b] = bins[g].get((k, b), 0) + 1
    s = quality.SMOOTHING

    def ratio(b):
        good, bad = seen[1].get(b, 0), seen[0].get(b, 0)
        x = math.log((good + s) / (n[1] + 2 * s)) - math.log((bad + s) / (n[0] + 2 * s))
        error = math.sqrt(1 / (good + s) - 1 / (n[1] + 2 * s) + 1 / (bad + s) - 1 / (n[0] + 2 * s))
        return x if abs(x) >= quality.TELLING * error else 0.0

    def evidence(text):
        e = sum(math.log((bins[1].get((k, b), 0) + s) / (n[1] + s * quality.BINS)) - math.log((bins[0].get((k, b), 0) + s) / (n[0] + s * quality.BINS)) for k, b in enumerate(shape(text)))
        telling = [r for b in grams(text) if (r := ratio(b))]
        e += sum(telling) * quality.WEIGHT / max(quality.WEIGHT, len(telling))
        return max(-quality.MOST_EVIDENCE, min(quality.MOST_EVIDENCE, e))

    share = (n[1] + 1) / (sum(n) + 2)
    odds = math.log(share / (1 - share))
    p = lambda x: 1 / (1 + math.exp(-x))
    ev = [evidence(t) for _, t, *_ in rows]
    paths, hosts = {}, {}
    for e, (_, _, lang, source) in zip(ev, rows):
        for table, key in ((paths, (source, lang)), (hosts, source)):
            c = table.setdefault(key, [0, 0.0])
            c[0] += 1
            c[1] += p(e + odds)

    def strength(table):
        total, g, var = sum(c[0] for c in table.values()), len(table), share * (1 - share)
        spread = (sum(c[0] * (c[1] / c[0] - share) ** 2 for c in table.values()) - (g - 1) * var) / (total - sum(c[0] ** 2 for c in table.values()) / total)
        return 1e6 if spread <= var * 1e-6 else min(1e6, max(1.0, var / spread - 1))

    kh, kp = strength(hosts), strength(paths)
    want = []
    for e, (i, _, lang, source) in zip(ev, rows):
        h, c = (hosts[source][1] + share * kh) / (hosts[source][0] + kh), paths[source, lang]
        prior = min(1 - 1e-9, max(1e-9, (c[1] - p(e + odds) + kp * h) / (c[0] - 1 + kp)))
        q = p(e + math.log(prior / (1 - prior)))
        want.append((i, round(e, 4), round(h, 6), round(prior, 6), round(q, 6), q >= 0.5))
    out = quality.classify(d, labels)
    assert out.columns == ["doc_id", "text", "lang", "source", "n", "c0", "evidence", "host_prior", "path_prior", "quality", "kept"]
    got = [(r.doc_id, round(r.evidence, 4), round(r.host_prior, 6), round(r.path_prior, 6), round(r.quality, 6), r.kept) for r in out.collect()]
    assert np.allclose(sorted(x[1] for x in got), sorted(x[1] for x in want), atol=1e-3) and np.allclose(sorted(x[4] for x in got), sorted(x[4] for x in want), atol=1e-4)
    assert {(x[0], x[5]) for x in got} == {(x[0], x[5]) for x in want}
    judged = {x[0]: x[5] for x in got if x[0] < 1000 and x[0] not in known}
    assert sum(judged[i] == bool(i % 4) for i in judged) >= 0.95 * len(judged)


def test_quality_shrinks_sparse_paths_to_their_host(spark):
    rows = [("h1", "p1", 0.9)] * 500 + [("h1", "p2", 0.1)] + [("h2", "p1", 0.1)] * 500 + [(None, None, 0.5)]
    got = {(r.host, r.path): r for r in quality.path_priors(spark.createDataFrame(rows, "host string, path string, p double"), 0.5).collect()}
    assert got["h1", "p1"].host_prior > 0.8 and got["h2", "p1"].host_prior < 0.2 and 0.4 < got[None, None].host_prior < 0.6


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[10:40] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, [1.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got: dict = {}
    for r in neighbours.nearest(d, d.where("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 10))
    hits = 0
    for q, found in got.items():
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(400), dist)) if i != q][:10]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11)) and [s for *_, s in found] == sorted(s for *_, s in found)
        assert all(abs(dist[v] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits / 400 >= 0.9
    assert [v for _, v, _ in got[10]] == list(range(11, 21))
    few = neighbours.nearest(d.where("vec_id < 4"), d.where("vec_id < 4"))
    assert few.count() == 12
    assert neighbours.nearest(d.limit(0), d.limit(0)).count() == 0


def test_neighbours_in_many_parts(spark, monkeypatch):
    """The table's own vectors (floats), in blocks so small that parts are told apart by projections and split by rows: recall against brute force."""
    for name, n in (("BLOCK_ROWS", 32), ("BLOCK_QUERIES", 4), ("PROBE_TASK", 4)):
        monkeypatch.setattr(neighbours, name, n)
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    ids, x = zip(*((r.vec_id, r.embedding) for r in d.collect()))
    ids, x = np.array(ids), np.array(x, np.float64)
    got = neighbours.nearest(d, d.where("vec_id % 20 = 0")).collect()
    hits = 0
    for q in ids[ids % 20 == 0]:
        dist = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, dist))] if i != q][:10]
        found = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(found) == 10 and all(abs(dist[ids == v][0] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits / (10 * (ids % 20 == 0).sum()) >= 0.9
    apart = spark.createDataFrame([(i, [float(10 ** (i % 300)), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(apart, apart).count() == 600


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding(spark, shards):
    many = docs(spark).unionByName(spark.range(3000).selectExpr("id + 100 AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text again and again' ELSE repeat('y', cast(id % 90 as int)) END AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")).withColumn("slot", F.lit("clash"))
    rows = sharding.shard(many, shards).collect()
    assert len(rows) == 3014
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8
        by.setdefault(r.shard, []).append(r)
    for s, own in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in own) == list(range(len(own)))
    if shards == 3:
        assert all(abs(sum(r.size for r in own) - total / 3) < 0.02 * total + max(r.size for r in rows) for own in by.values())
    assert sharding.shard(empty(spark), shards).count() == 0


def test_sharding_refines_to_small_runs(spark):
    """Runs of at most 2 KB: many levels and cells, the same law."""
    d = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a text that a third of all rows have' ELSE repeat('y', cast(id % 90 as int)) || id END AS text", "'c' AS c0", "'r' AS __run", "1 AS shard")
    keys = d.select(F.xxhash64("text").alias("__h1"), F.xxhash64("doc_id").alias("__h2"), sharding.row_bytes(F.col("text")).alias("__size"))
    runs = sharding.histogram_splits(keys, 24, run_bytes=2048)
    assert (runs["bytes"] <= 2048).all() and runs["rows"].sum() == 4000 and len(runs) > 80
    out = sharding.shard(d, 24, run_bytes=2048)
    assert sorted(out.columns) == sorted([*d.columns, "size", "slot"])
    rows = out.collect()
    by = {s: [r for r in rows if r.shard == s] for s in range(24)}
    total = sum(r.size for r in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 24) <= 0.001 * total / 24 + 2 * max(r.size for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(4000))


def test_sharding_of_rows_alike_in_id_and_text(spark):
    same = spark.range(0, 1000, 1, 3).selectExpr("CAST(NULL AS long) AS doc_id", "'one text' AS text", "'en' AS lang", "cast(id as string) AS source", "0L AS n_chars")
    twin = spark.range(0, 300, 1, 2).selectExpr("7L AS doc_id", "'another text of more bytes' AS text", "'en' AS lang", "cast(id + 1000 as string) AS source", "0L AS n_chars")
    d = same.unionByName(twin).unionByName(spark.range(2000).selectExpr("id AS doc_id", "'t' || id AS text", "'en' AS lang", "cast(id + 1300 as string) AS source", "0L AS n_chars"))
    rows = sharding.shard(d, 24).collect()
    assert sorted(int(r.source) for r in rows) == list(range(3300))
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert len(by) == 24
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 24) < 0.01 * total / 24 + 2 * max(r.size for r in rows)


def test_matroska_round_trip(spark):
    d = docs(spark).withColumn("media", F.lit("clash"))
    read = matroska.payload_features(matroska.demux(matroska.mux(d, "text")))
    for r in read.collect():
        want = matroska.padded((r.text or "").encode())
        assert len(want) % 576 == 0 and r.payload_bytes == len(want) and r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        assert len(r.packets) == len(want) // 576 and [p.timestamp_ms for p in r.packets] == [72.0 * k for k in range(len(r.packets))]
        assert [c.cluster_offset for c in r.cues] == [o for o in range(len(r.media)) if bytes(r.media[o : o + 4]) == b"\x1f\x43\xb6\x75"][: len(r.cues)] and r.error is None
    assert matroska.packet_table(matroska.demux(matroska.mux(d, "text")), "doc_id").where("length <> 576").count() == 0
    broken = spark.createDataFrame([(bytearray(b"\x1a\x45\xdf\xa3\x99garbage"),), (None,), (bytearray(b""),)], "media binary")
    assert sorted((r.error is not None, len(r.packets or [])) for r in matroska.demux(broken).collect()) == [(False, 0), (False, 0), (True, 0)]
    assert matroska.demux(matroska.mux(empty(spark), "text")).count() == 0


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.EBML_LACING])
def test_matroska_lacing_and_groups(lacing):
    rng = np.random.default_rng(lacing)
    frames = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (5, 700, 0, 255, 256, 3)]
    block = b"\x82" + b"\x00\x07" + bytes([lacing << 1]) + matroska.laced(frames, lacing)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block) + matroska.element(matroska.REFERENCE_BLOCK, b"\x01"))
    cluster = matroska.element(matroska.CLUSTER, matroska.uint(matroska.CLUSTER_TIMESTAMP, 1000) + group)
    unknown = (0x18538067).to_bytes(4, "big") + b"\x01" + b"\xff" * 7  # a segment of unknown size
    data = matroska.element(matroska.EBML, b"") + unknown + cluster
    m = matroska.read_media(data)
    assert [data[o : o + n] for _, _, o, n, _, _ in m["packets"]] == frames and {(t, ms, key) for t, ms, _, _, key, _ in m["packets"]} == {(2, 1007.0, False)}


def test_chat_paths_and_formats(spark):
    rows = [(1, 0, None, "user", "hi", 0.0), (1, 1, 0, "assistant", "a<|im_end|>&lt;|", 2.0), (1, 2, 0, "assistant", None, 5.0), (1, 3, 1, "user", "more", 1.0), (1, 4, 3, "assistant", "endé", None), (2, 0, None, "us\ner", "solo", 1.0), (3, 0, 1, "user", "cycle", 1.0), (3, 1, 0, "user", "cycle", 1.0), (None, 0, None, None, "x", None), (4, 9, 77, "assistant", "orphan", 1.0)]
    d = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    p = chat.paths(d, score="score")
    found = {(r.tree, r.leaf): (r.path_rank, r.path_score) for r in p.collect()}
    assert found == {(1, 2): (1, 5.0), (1, 4): (2, 3.0), (2, 0): (1, 1.0), (None, 0): (1, 0.0), (4, 9): (1, 1.0)}
    assert {(r.tree, r.leaf) for r in chat.paths(d, score="score", top=1).collect()} == {(1, 2), (2, 0), (None, 0), (4, 9)}
    out = chat.format_paths(d, p).select("tree", "leaf", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {(r.tree, r.leaf): r for r in out}
    assert [(t.role, t.text) for t in by[1, 4].turns] == [("user", "hi"), ("assistant", "a<|im_end|>&lt;|"), ("user", "more"), ("assistant", "endé")]
    assert by[1, 4].loss == "a<|im_end|>&lt;|endé" and by[1, 2].loss == "" and [(t.role, t.text) for t in by[2, 0].turns] == [("us\ner", "solo")]
    assert by[1, 4].formatted.count("<|im_start|>") == 4
    none = d.limit(0)
    assert chat.format_paths(none, chat.paths(none)).count() == 0


def test_linear_chat_with_repeated_turns(spark):
    d = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = chat.linear_parents(d)
    (r,) = chat.format_paths(rows, chat.paths(rows)).collect()
    assert r.formatted == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_chat_paths_are_brute_force(spark):
    rng = np.random.default_rng(6)
    parents = {t: {n: (int(rng.integers(0, n)) if rng.random() < 0.9 else None) if n else None for n in range(25)} for t in (1, 2, None)}
    parents[2] |= {n: n - 1 for n in range(1, 20)}
    score = {(t, n): float(rng.integers(-3, 4)) for t in parents for n in parents[t]}
    long_text = LONG[:50_000]
    rows = [(t, n, p, "user", long_text if n == 3 else f"t{n}", score[t, n], "x", 7) for t in parents for n, p in parents[t].items()]
    d = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double, up string, steps int")
    for top in (None, 2):
        want = {}
        for t, up in parents.items():
            found = []
            for leaf in set(up) - set(up.values()):
                path = [leaf]
                while up[path[-1]] is not None:
                    path.append(up[path[-1]])
                found.append((-sum(score[t, n] for n in path), leaf, path[::-1]))
            want |= {(t, leaf): (k + 1, -s, path) for k, (s, leaf, path) in enumerate(sorted(found)) if top is None or k < top}
        got: dict = {}
        p = chat.paths(d, score="score", top=top)
        for r in p.orderBy("depth").collect():
            got.setdefault((r.tree, r.leaf), (r.path_rank, r.path_score, []))[2].append(r.node)
        assert got == want
    texts = {(r.tree, r.leaf): [x.text for x in r.turns] for r in chat.format_paths(d, p).select("tree", "leaf", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert texts == {k: [long_text if n == 3 else f"t{n}" for n in v[2]] for k, v in want.items()}


def test_minhash_hub_of_many_spokes_and_text_ids(spark, monkeypatch):
    """Near copies of one text, several hundred of them, verified in small blocks; ids as text."""
    monkeypatch.setattr(minhash, "SPOKES", 16)
    rng = np.random.default_rng(8)
    base = [f"h{k}" for k in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"e{i}"
        rows.append((str(i + 5), " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), 85).collect()
    assert {r.component_id for r in got} == {5} and [r.doc_id for r in got if r.kept] == [5] and len(got) == 400
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        minhash.near_duplicates(spark.createDataFrame([("a", "x y")], "doc_id string, text string")).collect()
