"""Alignment of sequences onto graphs against all ways through them, and the graph's next version."""

import random

import duckdb
import pytest

from cladeframe.operators import graph_alignment as ga
from cladeframe.plans import ancestor_queries


def _ways(links, width, at=-1):
    if at == width:
        yield []
    for a, b in links:
        if a == at:
            for rest in _ways(links, width, b):
                yield [b, *rest] if b != width else rest


def _best(shares, links, text, width, pair, gap, skip):
    """Over all paths, the usual program of two strings."""
    best = None
    for way in _ways(links, width):
        row = [gap * j for j in range(len(text) + 1)]
        for v in way:
            total = sum(shares[v].values())
            new = [row[0] + skip]
            for j, b in enumerate(text, 1):
                new.append(max(row[j - 1] + sum(n * pair(a, b) for a, n in shares[v].items()) / total, row[j] + skip, new[-1] + gap))
            row = new
        best = row[-1] if best is None else max(best, row[-1])
    return best


def _value(path, shares, pair, gap, skip):
    total = 0.0
    for v, s in path:
        total += gap if v is None else skip if s is None else sum(n * pair(a, s) for a, n in shares[v].items()) / sum(shares[v].values())
    return total


def test_best_way_is_the_best_of_all():
    r = random.Random(5)
    pair = lambda a, b: 2.0 if a == b else -1.0
    for _ in range(60):
        width = r.randrange(2, 7)
        shares = {v: {c: r.randrange(1, 4) for c in r.sample("ACG", r.randrange(1, 3))} for v in range(width)}
        links = sorted({(a, b) for a in range(-1, width) for b in range(a + 1, width + 1) if r.random() < 0.5 and b > a} - {(-1, -1)})
        text = "".join(r.choice("ACG") for _ in range(r.randrange(0, 6)))
        got, want = ga.aligned(list(shares.items()), links, text, width, pair, -1.5, -1.0), _best(shares, links, text, width, pair, -1.5, -1.0)
        assert (got is None) == (want is None)
        if got is not None:
            score, path = got
            assert score == pytest.approx(want) == pytest.approx(_value(path, shares, pair, -1.5, -1.0))
            assert "".join(s for _, s in path if s is not None) == text
            on = [-1, *(v for v, _ in path if v is not None), width]
            assert all(step in links for step in zip(on, on[1:]))


def test_sequences_are_threaded_into_the_next_version(spark, monkeypatch):
    monkeypatch.setattr(ga, "TASK_CELLS", 10)
    nodes = spark.createDataFrame([("g", 0, "A", 2), ("g", 1, "C", 2), ("g", 2, "T", 2), ("h", 0, "A", 1), (None, 0, "A", 1), ("g", None, "A", 1)], "graph string, pos long, sym string, n long")
    edges = spark.createDataFrame([("g", -1, 0, 2), ("g", 0, 1, 2), ("g", 1, 2, 2), ("g", 2, 3, 2), ("h", -1, 0, 1)], "graph string, from_pos long, to_pos long, n long")
    seqs = spark.createDataFrame([("g", "s", "ACT"), ("g", "s", "ACT"), ("g", "t", "AGGCT"), ("g", "u", "AT"), ("g", "v", None), ("g", "w", ""), ("h", "x", "A"), ("none", "y", "A")], "graph string, seq string, text string")
    steps = ga.align(nodes, edges, seqs, 3)
    got = {}
    for r in steps.orderBy("step").collect():
        got.setdefault(r.seq, []).append((r.pos, r.sym))
    assert got == {"s": [(0, "A"), (1, "C"), (2, "T")], "t": [(0, "A"), (None, "G"), (None, "G"), (1, "C"), (2, "T")], "u": [(0, "A"), (1, None), (2, "T")], "w": [(0, None), (1, None), (2, None)]}
    assert {r.seq: r.score for r in steps.select("seq", "score").distinct().collect()} == {"s": 6.0, "t": 2.0, "u": 2.0, "w": -6.0}
    new, links = ga.threaded(steps, nodes, edges, 3)
    assert {(r.node, r.sym): r.n for r in new.where("graph = 'g'").collect()} == {("0", "A"): 5, ("1", "C"): 4, ("2", "T"): 5, ("t:1", "G"): 1, ("t:2", "G"): 1}
    assert {(r.from_node, r.to_node): r.n for r in links.where("graph = 'g'").collect()} == {("-1", "0"): 5, ("0", "1"): 3, ("1", "2"): 4, ("2", "3"): 5, ("0", "t:1"): 1, ("t:1", "t:2"): 1, ("t:2", "1"): 1, ("0", "2"): 1}
    scored = ga.align(nodes, edges, seqs.where("seq = 'u'"), 3, matrix={("A", "A"): 5.0, ("T", "T"): 1.0}, skip=-0.5).first().score
    assert scored == 5.5 and ga.align(nodes, edges, seqs.limit(0), 3).count() == 0


def test_equal_texts_are_aligned_once(spark, monkeypatch):
    nodes = spark.createDataFrame([("g", 0, "A", 1), ("g", 1, "C", 1)], "graph string, pos long, sym string, n long")
    edges = spark.createDataFrame([("g", -1, 0, 1), ("g", 0, 1, 1), ("g", 1, 2, 1)], "graph string, from_pos long, to_pos long, n long")
    texts = {str(i): "AC" if i % 2 else "AGC" for i in range(40)}
    seen, dealt = [], ga.dealt
    monkeypatch.setattr(ga, "dealt", lambda pairs: seen.append(pairs.count()) or dealt(pairs))
    steps = ga.align(nodes, edges, spark.createDataFrame([("g", k, t) for k, t in texts.items()], "graph string, seq string, text string"), 2).orderBy("seq", "step").collect()
    assert seen == [2]
    assert {k: "".join(r.sym for r in steps if r.seq == k and r.sym) for k in texts} == texts


def _parts(spark, tmp_path):
    """Parts whose names are alike in their first 45 letters, and others of other lengths."""
    same = "".join("abcde"[i * i % 5] for i in range(45))
    names = {0: same + "xxyyy", 10: same + "xz", 1: same + "xxyyy", 2: same + "zzzzzzz", 3: same, 11: "short", 12: "", 13: None, 20: "é€𝄞" * 20, 21: "é€𝄞" * 19 + "é"}
    rows = [(k, "t" if k < 20 else "u", name) for k, name in names.items()] + [(31, "alone", "no graph")]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    return c


def test_whole_names_are_aligned(spark, tmp_path):
    c = _parts(spark, tmp_path)
    got = {r.seq: (r.graph, r.score) for r in ancestor_queries.graph_alignment(spark, str(tmp_path)).collect()}
    assert got["1"][1] > got["2"][1] and got["1"][1] > got["3"][1]
    assert got == {k: (g, s) for g, k, s in c.execute(ancestor_queries.ORACLE_SQL["graph_alignment"]).fetchall()}


def test_whole_names_are_threaded(spark, tmp_path):
    c = _parts(spark, tmp_path)
    got = {r.graph: r.n for r in ancestor_queries.graph_next_version(spark, str(tmp_path)).collect()}
    assert got == {"t": 50 + 47 + 50 + 52 + 45 + 5, "u": 60 + 58} == dict(c.execute(ancestor_queries.ORACLE_SQL["graph_next_version"]).fetchall())
