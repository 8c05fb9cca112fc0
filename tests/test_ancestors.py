"""Batched dynamic programs against one site at a time, position trees, ancestral sequences, cheapest paths."""

import heapq
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import ancestors, columns, graphs, paths, reconstruction
from cladeframe.plans import models
from cladeframe.plans.tree import parse

TREE = parse("(((a:0.1,b:0.3)u:0.2,c:0.4)v:0.1,(d:0.2,(e:0.5,f:0.1)w:0.3)x:0.2)r;")


def _sites(spark, n=40, letters="ACGT", seed=1, missing=0.2):
    r = random.Random(seed)
    rows = [(s, TREE.labels[i], None if r.random() < missing / 2 else r.choice(letters)) for s in range(n) for i in TREE.leaves if r.random() > missing]
    rows += [(None, "a", "A"), (n, None, "A"), (n + 1, "nobody", "C"), (n + 2, "a", None), (3, "a", "A"), (3, "a", "T")]
    by = {}
    for s, leaf, state in sorted(rows, key=lambda x: (x[0] is None, x[0], x[1] or "", x[2] or "")):
        by.setdefault(s, {})
        if leaf in TREE.labels:
            by[s][leaf] = state  # of repeated rows the last counts; a null site is one of its own
    return spark.createDataFrame(rows, "site long, leaf string, state string"), by


def _every(states):
    inner = [i for i, c in enumerate(TREE.children) if c]
    return inner, itertools.product(range(len(states)), repeat=len(inner))


def test_parsimony_in_batches_is_that_of_each_site(spark, monkeypatch):
    sites, by = _sites(spark, 12, "ACG")
    want = set()
    for s, leaves in by.items():
        kinds = sorted({x for x in leaves.values() if x is not None})
        if not kinds:
            continue
        inner = [i for i, c in enumerate(TREE.children) if c]
        free = [i for i in TREE.leaves if leaves.get(TREE.labels[i]) is None]
        scored = {}
        for pick in itertools.product(range(len(kinds)), repeat=len(inner) + len(free)):
            state = dict(zip(inner + free, pick))
            for i in TREE.leaves:
                if i not in state:
                    state[i] = kinds.index(leaves[TREE.labels[i]])
            scored.setdefault(sum(state[i] != state[TREE.parents[i]] for i in range(1, len(TREE.labels))), []).append(state)
        least = min(scored)
        want |= {(s, TREE.labels[i], kinds[k], least) for state in scored[least] for i, k in state.items()}
    got = {tuple(r) for r in reconstruction.parsimony(sites, TREE).collect()}
    assert got == want
    monkeypatch.setattr(columns, "CELLS", 40)  # one site a slice
    assert {tuple(r) for r in reconstruction.parsimony(sites, TREE).collect()} == want
    assert reconstruction.parsimony(sites.limit(0), TREE).count() == 0


def _brute_joint(model, leaves, present=None, rate=1.0):
    """The best log-likelihood and the states of all assignments that reach it."""
    n, k = len(TREE.labels), len(model.alphabet)
    nodes = [i for i in range(n) if present is None or i in present]
    steps = [np.log(model.transition(d * rate)) for d in TREE.dists]
    fixed = {i: model.alphabet.index(leaves[TREE.labels[i]]) for i in nodes if leaves.get(TREE.labels[i]) in model.alphabet and not TREE.children[i]}
    free = [i for i in nodes if i not in fixed]
    best, top = None, -np.inf
    for pick in itertools.product(range(k), repeat=len(free)):
        st = {**fixed, **dict(zip(free, pick))}
        total = sum(steps[i][st[TREE.parents[i]], st[i]] if i and TREE.parents[i] in st else np.log(model.freqs[st[i]]) for i in nodes)
        if total > top + 1e-12:
            best, top = st, total
    return best, top


def test_joint_states_with_and_without_position_trees(spark):
    model = models.three_state()
    sites, by = _sites(spark, 8, "VAN", seed=4)
    got = {(r.site, r.node): (r.state, r.log_likelihood) for r in reconstruction.joint(sites, TREE, model).collect()}
    for s in range(8):
        best, top = _brute_joint(model, by[s])
        assert got[(s, "r")][1] == pytest.approx(top, abs=1e-9)
        chosen = {i: model.alphabet.index(got[(s, TREE.labels[i])][0]) for i, c in enumerate(TREE.children) if c}
        fixed, again = _brute_joint(model, {**by[s]})
        assert {i: fixed[i] for i in chosen} == chosen or again == pytest.approx(top)
    r = random.Random(9)
    masks = {s: {i for i in range(len(TREE.labels)) if r.random() < 0.7} for s in range(8)}
    present = spark.createDataFrame([(s, TREE.labels[i]) for s, m in masks.items() for i in m] + [(1, "nobody")], "site long, node string")
    trees = ancestors.position_trees(present, TREE, orphans=True)
    got_trees = {(t.site, t.node): t.parent for t in trees.collect()}
    assert got_trees == {(s, TREE.labels[i]): TREE.labels[TREE.parents[i]] if i and TREE.parents[i] in m else None for s, m in masks.items() for i in m}
    fed = {(t.site, t.node) for t in ancestors.position_trees(present, TREE).collect()}
    for s, m in masks.items():
        part = {i: i for i in m}
        for i in sorted(m):
            if i and TREE.parents[i] in m:
                part[i] = part[TREE.parents[i]]
        with_leaf = {part[i] for i in m if not TREE.children[i]}
        assert {n for t, n in fed if t == s} == {TREE.labels[i] for i in m if part[i] in with_leaf}
    states = {(x.site, x.node): (x.state, x.log_likelihood) for x in ancestors.joint_states(sites, trees, TREE, model).collect()}
    for s, m in masks.items():
        shown = {TREE.labels[i]: by[s].get(TREE.labels[i]) for i in m}
        best, top = _brute_joint(model, shown, m)
        inner = [i for i in m if TREE.children[i]]
        assert {n for t, n in states if t == s} == {TREE.labels[i] for i in inner}
        for i in inner:
            assert states[(s, TREE.labels[i])][1] == pytest.approx(top, abs=1e-9)


def test_regained_positions(spark):
    r = random.Random(2)
    masks = {s: {i for i in range(len(TREE.labels)) if r.random() < 0.6} for s in range(30)}
    want = set()
    for s, m in masks.items():
        for i in m:
            at, lost = TREE.parents[i], False
            while at > 0:
                lost |= at not in m
                at = TREE.parents[at]
            if lost:
                want.add((s, TREE.labels[i]))
    present = spark.createDataFrame([(s, TREE.labels[i]) for s, m in masks.items() for i in m], "site long, node string")
    assert {tuple(x) for x in ancestors.regained(present, TREE).collect()} == want
    assert ancestors.regained(present.limit(0), TREE).count() == 0


def _dijkstra(edges, start):
    out, heap, ahead = {}, [(0.0, 0, start)], {}
    for a, b, c in edges:
        ahead.setdefault(a, []).append((b, c))
    while heap:
        c, s, x = heapq.heappop(heap)
        if x in out:
            continue
        out[x] = (c, s)
        for y, w in ahead.get(x, []):
            heapq.heappush(heap, (c + w, s + 1, y))
    return out


def test_cheapest_paths_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK_EDGES", 20)
    r = random.Random(3)
    every = {g: [(r.randrange(-1, 25), r.randrange(-1, 25), float(r.randrange(0, 6))) for _ in range(80)] for g in ("p", "q")}
    every["none"] = [(-1, 2, 1.0), (3, 24, 1.0)]
    rows = [(g, a, b, c) for g, es in every.items() for a, b, c in es] + [("p", None, 3, 1.0), ("p", 4, 5, None), ("p", 4, 5, float("inf"))]
    edges = spark.createDataFrame(rows, "graph string, from_pos long, to_pos long, cost double")
    e = paths.blocked(edges)
    assert e.select("block").distinct().count() > 5
    start = spark.createDataFrame([(g, -1) for g in every], "graph string, pos long")
    got = {}
    for x in paths.distances(e, start).collect():
        got.setdefault(x.graph, {})[x.pos] = (x.cost, x.steps)
    assert got == {g: _dijkstra(es, -1) for g, es in every.items()}
    found = {}
    for x in paths.cheapest(edges, -1, 24).orderBy("step").collect():
        found.setdefault(x.graph, []).append((x.pos, x.cost))
    least = {g: {(a, b): min(c for p, q, c in es if (p, q) == (a, b)) for a, b, _ in es} for g, es in every.items()}
    assert "none" not in found
    for g in ("p", "q"):
        if 24 in got[g]:
            way = [p for p, _ in found[g]]
            assert way[0] == -1 and way[-1] == 24 and sum(least[g][s] for s in zip(way, way[1:])) == got[g][24][0] == found[g][0][1]
        else:
            assert g not in found
    back = {g: _dijkstra([(b, a, c) for a, b, c in es], 24) for g, es in every.items()}
    bound = spark.createDataFrame([(g, p, c * 0.9) for g, d in back.items() for p, (c, _) in d.items()], "graph string, pos long, least double")
    again = {(x.graph, x.step, x.cost) for x in paths.cheapest(edges, -1, 24, bound).collect()}
    assert {(g, c) for g, _, c in again} == {(g, p[0][1]) for g, p in found.items()}
    inf = float("inf")
    ahead1, back1 = ({g: _dijkstra([(b, a, 1.0) if t else (a, b, 1.0) for a, b, _ in es], 24 if t else -1) for g, es in every.items()} for t in (False, True))
    for x in paths.ways(edges, -1, 24).collect():
        assert x.before == got[x.graph].get(x.from_pos, (inf,))[0] and x.after == back[x.graph].get(x.to_pos, (inf,))[0]
        assert x.steps_before == ahead1[x.graph].get(x.from_pos, (0, None))[1] and x.steps_after == back1[x.graph].get(x.to_pos, (0, None))[1]
    with pytest.raises(ValueError):
        paths.blocked(edges.unionByName(spark.createDataFrame([("p", 1, 2, -1.0)], edges.schema)))
    assert paths.cheapest(edges.limit(0), -1, 24).count() == 0


def test_one_graph_of_a_hundred_thousand_edges(spark):
    n = 20_000
    e = spark.range(-1, n).select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"), F.col("id").alias("from_pos")).where(F.col("from_pos") + F.col("k") <= n)
    e = e.select(F.lit("g").alias("graph"), "from_pos", (F.col("from_pos") + F.col("k")).alias("to_pos"), (F.pmod(F.xxhash64("from_pos", "k"), F.lit(97)) + 1).cast("double").alias("cost"))
    rows = [(r.from_pos, r.to_pos, r.cost) for r in e.collect()]
    assert len(rows) > 99_000
    want = _dijkstra(rows, -1)
    way = paths.cheapest(e, -1, n).orderBy("step").collect()
    assert way[0].pos == -1 and way[-1].pos == n and {r.cost for r in way} == {want[n][0]}
    cost = {(a, b): c for a, b, c in rows}
    assert sum(cost[(a.pos, b.pos)] for a, b in zip(way, way[1:])) == want[n][0]


def test_sequences_of_ancestors(spark):
    rows = {"a": "AC-T", "b": "AC-T", "c": "A-GT", "d": "CCGT", "e": "C-GT", "f": "C-GT"}
    al = spark.createDataFrame([(k, p, None if c == "-" else c) for k, s in rows.items() for p, c in enumerate(s)] + [(None, 0, "A")], "leaf string, pos long, sym string")
    got = {r.node: (r.sequence, r.gapped, r.cost) for r in ancestors.sequences(al, TREE, models.jc("ACGT"), 4).collect()}
    assert got["u"][:2] == ("ACT", "AC-T") and got["w"][:2] == ("CGT", "C-GT")
    assert set(got) <= {"r", "u", "v", "w", "x"} and all(g.replace("-", "") == s for s, g, _ in got.values())
    assert ancestors.sequences(al.limit(0), TREE, models.jc("ACGT"), 4).count() == 0
    e = reconstruction.bidirectional_edge_parsimony(al.where("leaf IS NOT NULL"), TREE, 4)
    assert ancestors.outside_alignment(e, al.where("leaf IS NOT NULL"), 4).first().outside == 0
    more = e.unionByName(spark.createDataFrame([("r", 0, 4, True)], "node string, from_pos long, to_pos long, recip boolean"))
    assert tuple(ancestors.outside_alignment(more, al.where("leaf IS NOT NULL"), 4).first())[1:] == (1, 1 / 5)


def test_gapped_text_needs_no_look_up_for_each_position(spark, monkeypatch):
    from pyspark.sql import functions

    monkeypatch.setattr(functions, "map_from_entries", None)  # its look-ups are linear
    al = spark.createDataFrame([(leaf, pos, sym) for leaf in "ab" for pos, sym in enumerate([None, "A", None, None, "C", None])], "leaf string, pos long, sym string")
    r = ancestors.sequences(al, parse("(a:0.1,b:0.2)r;"), models.jc(("A", "C")), 6).first()
    assert (r.node, r.sequence, r.gapped) == ("r", "AC", "-A--C-")


@pytest.mark.parametrize("blocks", [4, 50_000])
def test_rounds_do_not_multiply_guessed_sizes(spark, monkeypatch, capsys, blocks):
    monkeypatch.setattr(paths, "BLOCK_EDGES", blocks)
    n = 40
    way = paths.cheapest(spark.range(-1, n).selectExpr("'g' AS graph", "id AS from_pos", "id + 1 AS to_pos", "1D AS cost"), -1, n)
    capsys.readouterr()
    way.explain("cost")
    powers = [int(x) for x in re.findall(r"sizeInBytes=[\d.]+E\+(\d+)", capsys.readouterr().out)]
    assert max(powers, default=0) < 100  # each round squared what Spark guesses, a number of as many digits as the path has nodes
    assert [r.pos for r in way.orderBy("step").collect()] == list(range(-1, n + 1))
