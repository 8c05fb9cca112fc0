"""SQL of the dynamic programs along the tree of eight groups of users, level by level."""

from __future__ import annotations

#: Each node of the tree and its parent, and the tree's inner nodes.
_EDGES = "tr(node, parent) AS (VALUES ('g0', 'll'), ('g1', 'll'), ('g2', 'lr'), ('g3', 'lr'), ('g4', 'rl'), ('g5', 'rl'), ('g6', 'rr'), ('g7', 'rr'), ('ll', 'l'), ('lr', 'l'), ('rl', 'r'), ('rr', 'r'), ('l', 'root'), ('r', 'root'))"
INNER = "('root', 'l', 'r', 'll', 'lr', 'rl', 'rr')"
_LEAVES = "lv AS (SELECT 'g' || i AS node FROM range(8) t(i))"

#: From ``we`` (node, from_pos, to_pos, w) and ``wd`` (width): ``far`` (node, pos, c), the cheapest way from -1, and ``way`` (node, pos), the positions of one cheapest path to the end.
WAY = """ah(node, pos, n, c) AS (SELECT DISTINCT node, -1::BIGINT, 0, 0::DOUBLE FROM we UNION ALL SELECT a.node, we.to_pos, a.n + 1, min(a.c + we.w) FROM ah a JOIN we ON we.node = a.node AND we.from_pos = a.pos GROUP BY ALL),
far AS MATERIALIZED (SELECT node, pos, min(c) AS c FROM ah GROUP BY ALL),
pred AS MATERIALIZED (SELECT we.node, we.to_pos AS pos, min(we.from_pos) AS prev FROM we JOIN far a ON a.node = we.node AND a.pos = we.from_pos JOIN far b ON b.node = we.node AND b.pos = we.to_pos WHERE a.c + w <= b.c + 1e-9 * greatest(abs(b.c), 1) GROUP BY ALL),
way(node, pos) AS (SELECT far.node, pos FROM far, wd WHERE pos = width UNION ALL SELECT way.node, pred.prev FROM way JOIN pred ON pred.node = way.node AND pred.pos = way.pos)"""


def parsimony(known: str, free: str = "SELECT NULL::BIGINT AS site, NULL AS node WHERE false", default: str | None = None) -> str:
    """CTEs up to ``best`` (site, node, s) and ``score`` (site, score) of most parsimonious states. ``known``: site, node, s; ``free``: leaves of
    a site that may have any state; the others too, unless there is a ``default``."""
    fallback = f"'{default}'" if default is not None else "NULL"
    out = [
        _EDGES, _LEAVES, f"known AS MATERIALIZED ({known})", f"free AS MATERIALIZED ({free})",
        f"leafs AS MATERIALIZED (SELECT x.site, lv.node, coalesce(k.s, CASE WHEN f.node IS NULL THEN {fallback} END) AS own FROM (SELECT DISTINCT site FROM known UNION SELECT DISTINCT site FROM free) x CROSS JOIN lv LEFT JOIN known k ON k.site = x.site AND k.node = lv.node LEFT JOIN free f ON f.site = x.site AND f.node = lv.node)",
        "states AS MATERIALIZED (SELECT DISTINCT site, own AS s FROM leafs WHERE own IS NOT NULL)",
        "c0 AS MATERIALIZED (SELECT l.site, l.node, states.s, CASE WHEN l.own IS NULL OR l.own = states.s THEN 0 ELSE 1000000 END AS cost FROM leafs l JOIN states ON l.site = states.site)",
    ]
    for k in (1, 2, 3):
        out.append(f"c{k} AS MATERIALIZED (SELECT site, parent AS node, s, sum(least(cost, m + 1)) AS cost FROM (SELECT *, min(cost) OVER (PARTITION BY site, node) AS m FROM c{k - 1}) x JOIN tr ON x.node = tr.node GROUP BY ALL)")
    out.append("score AS (SELECT site, min(cost)::INT AS score FROM c3 GROUP BY site)")
    out.append("b3 AS MATERIALIZED (SELECT c3.site, node, s FROM c3 JOIN score ON c3.site = score.site AND cost = score)")
    for k in (2, 1, 0):
        out.append(f"b{k} AS MATERIALIZED (SELECT DISTINCT c.site, c.node, c.s FROM (SELECT *, min(cost) OVER (PARTITION BY site, node) AS m FROM c{k}) c JOIN tr ON c.node = tr.node JOIN b{k + 1} b ON b.site = c.site AND b.node = tr.parent JOIN c{k} same ON same.site = c.site AND same.node = c.node AND same.s = b.s WHERE c.cost + CASE WHEN c.s = b.s THEN 0 ELSE 1 END = least(same.cost, c.m + 1))")
    out.append("best AS (SELECT * FROM b3 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b0)")
    return ",\n".join(out)


def _likelihood(known: str, alphabet: str, time: float) -> list[str]:
    """CTEs of the leaves' vectors and of the chances of a step of ``time`` under equal rates."""
    return [
        _EDGES, _LEAVES, f"known AS MATERIALIZED ({known})", f"letters AS MATERIALIZED ({alphabet})", "size AS (SELECT count(*)::DOUBLE AS k FROM letters)",
        f"step AS MATERIALIZED (SELECT a.s AS x, b.s AS y, CASE WHEN a.s = b.s THEN 1 / k + (1 - 1 / k) * exp(-{time}::DOUBLE) ELSE (1 - exp(-{time}::DOUBLE)) / k END AS p FROM letters a, letters b, size)",
        "u0 AS MATERIALIZED (SELECT x.site, lv.node, letters.s, CASE WHEN k.s IS NULL OR k.s = letters.s THEN 1::DOUBLE ELSE 0 END AS up FROM (SELECT DISTINCT site FROM known) x CROSS JOIN lv CROSS JOIN letters LEFT JOIN known k ON k.site = x.site AND k.node = lv.node)",
    ]


def joint(known: str, alphabet: str, time: float) -> str:
    """CTEs up to ``best`` (site, node, s) and ``top`` (site, lp): the jointly most probable states; ties, to nine digits, to the earlier letter."""
    out = _likelihood(known, alphabet, time)
    out.append("w0 AS (SELECT site, node, s, CASE WHEN up > 0 THEN 0::DOUBLE ELSE -1e300 END AS up FROM u0)")
    for k in (1, 2, 3):
        out.append(f"m{k} AS MATERIALIZED (SELECT site, node, x AS above, y AS s, up + ln(p) AS v FROM w{k - 1} JOIN step ON s = y)")
        out.append(f"h{k} AS MATERIALIZED (SELECT site, node, above, max(v) AS v, min(s) FILTER (round(v, 9) = top) AS s FROM (SELECT *, max(round(v, 9)) OVER (PARTITION BY site, node, above) AS top FROM m{k}) GROUP BY ALL)")
        out.append(f"w{k} AS MATERIALIZED (SELECT site, parent AS node, above AS s, sum(v) AS up FROM h{k} JOIN tr USING (node) GROUP BY ALL)")
    out.append("top AS (SELECT site, max(up) - ln(k) AS lp FROM w3, size GROUP BY site, k)")
    out.append("b3 AS MATERIALIZED (SELECT site, node, min(s) AS s FROM (SELECT *, max(round(up, 9)) OVER (PARTITION BY site) AS t FROM w3) WHERE round(up, 9) = t GROUP BY ALL)")
    for k in (2, 1):
        out.append(f"b{k} AS MATERIALIZED (SELECT h.site, h.node, h.s FROM h{k + 1} h JOIN tr ON h.node = tr.node JOIN b{k + 1} b ON b.site = h.site AND b.node = tr.parent AND h.above = b.s)")
    out.append("best AS (SELECT * FROM b3 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b1)")
    return ",\n".join(out)


def joint_recoded(known: str, time: float) -> str:
    """CTEs up to ``best`` (site, node, s): the jointly most probable states under equal rates between the states that the site's leaves show."""
    goes = f"(1 - exp(-{time}::DOUBLE)) / k"
    out = [
        _EDGES, _LEAVES, f"known AS MATERIALIZED ({known})", "letters AS MATERIALIZED (SELECT DISTINCT site, s FROM known)", "size AS MATERIALIZED (SELECT site, count(*)::DOUBLE AS k FROM letters GROUP BY site)",
        f"step AS MATERIALIZED (SELECT a.site, a.s AS x, b.s AS y, CASE WHEN a.s = b.s THEN 1 - (k - 1) * (1 - exp(-{time}::DOUBLE)) / k ELSE {goes} END AS p FROM letters a JOIN letters b ON a.site = b.site JOIN size ON size.site = a.site)",
        "w0 AS MATERIALIZED (SELECT l.site, lv.node, l.s, CASE WHEN k.s IS NULL OR k.s = l.s THEN 0::DOUBLE ELSE -1e300 END AS up FROM letters l CROSS JOIN lv LEFT JOIN known k ON k.site = l.site AND k.node = lv.node)",
    ]
    for k in (1, 2, 3):
        out.append(f"m{k} AS MATERIALIZED (SELECT w.site, node, x AS above, y AS s, up + ln(p) AS v FROM w{k - 1} w JOIN step ON step.site = w.site AND s = y)")
        out.append(f"h{k} AS MATERIALIZED (SELECT site, node, above, max(v) AS v, min(s) FILTER (round(v, 9) = top) AS s FROM (SELECT *, max(round(v, 9)) OVER (PARTITION BY site, node, above) AS top FROM m{k}) GROUP BY ALL)")
        out.append(f"w{k} AS MATERIALIZED (SELECT site, parent AS node, above AS s, sum(v) AS up FROM h{k} JOIN tr USING (node) GROUP BY ALL)")
    out.append("b3 AS MATERIALIZED (SELECT site, node, min(s) AS s FROM (SELECT *, max(round(up, 9)) OVER (PARTITION BY site) AS t FROM w3) WHERE round(up, 9) = t GROUP BY ALL)")
    for k in (2, 1):
        out.append(f"b{k} AS MATERIALIZED (SELECT h.site, h.node, h.s FROM h{k + 1} h JOIN tr ON h.node = tr.node JOIN b{k + 1} b ON b.site = h.site AND b.node = tr.parent AND h.above = b.s)")
    out.append("best AS (SELECT * FROM b3 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b1)")
    return ",\n".join(out)


def masked(known: str, present: str, alphabet: str, time: float) -> str:
    """CTEs up to ``best`` (site, node, s) and ``top`` (site, lp): jointly most probable states where only ``present`` nodes (site, node) count and each group of
    connected ones is a tree of its own."""
    out = _likelihood(known, alphabet, time)
    out[0] = "lev(node, level) AS (VALUES ('root', 3), ('l', 2), ('r', 2), ('ll', 1), ('lr', 1), ('rl', 1), ('rr', 1))"
    out.insert(0, f"pr AS MATERIALIZED ({present})")
    out.append("w0 AS MATERIALIZED (SELECT u0.site, u0.node, s, CASE WHEN up > 0 THEN 0::DOUBLE ELSE -1e300 END AS up FROM u0 JOIN pr USING (site, node))")
    for k in (1, 2, 3):
        out.append(f"m{k} AS MATERIALIZED (SELECT w.site, w.node, x AS above, y AS s, up + ln(p) AS v FROM w{k - 1} w JOIN step ON s = y JOIN tr ON tr.node = w.node JOIN pr ON pr.site = w.site AND pr.node = tr.parent)")
        out.append(f"h{k} AS MATERIALIZED (SELECT site, node, above, max(v) AS v, min(s) FILTER (round(v, 9) = top) AS s FROM (SELECT *, max(round(v, 9)) OVER (PARTITION BY site, node, above) AS top FROM m{k}) GROUP BY ALL)")
        out.append(f"w{k} AS MATERIALIZED (SELECT pr.site, pr.node, letters.s, coalesce(z.up, 0) AS up FROM pr JOIN lev ON lev.node = pr.node AND level = {k} CROSS JOIN letters LEFT JOIN (SELECT site, parent AS node, above AS s, sum(v) AS up FROM h{k} JOIN tr USING (node) GROUP BY ALL) z ON z.site = pr.site AND z.node = pr.node AND z.s = letters.s)")
    for k in (3, 2, 1, 0):
        out.append(f"o{k} AS MATERIALIZED (SELECT site, node, min(s) AS s, max(up) AS up FROM (SELECT w.*, max(round(up, 9)) OVER (PARTITION BY w.site, w.node) AS t FROM w{k} w LEFT JOIN tr ON tr.node = w.node LEFT JOIN pr ON pr.site = w.site AND pr.node = tr.parent WHERE pr.node IS NULL) WHERE round(up, 9) = t GROUP BY ALL)")
    out.append("top AS (SELECT site, sum(up - ln(k)) AS lp FROM (SELECT * FROM o3 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o0), size GROUP BY site)")
    out.append("b3 AS MATERIALIZED (SELECT site, node, s FROM o3)")
    for k in (2, 1):
        out.append(f"b{k} AS MATERIALIZED (SELECT h.site, h.node, h.s FROM h{k + 1} h JOIN tr ON h.node = tr.node JOIN b{k + 1} b ON b.site = h.site AND b.node = tr.parent AND h.above = b.s UNION ALL SELECT site, node, s FROM o{k})")
    out.append("best AS (SELECT * FROM b3 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b1)")
    return ",\n".join(out)


def root_posterior(known: str, alphabet: str, time: float) -> str:
    """CTEs up to ``post`` (site, s, p, lp)."""
    out = _likelihood(known, alphabet, time)
    for k in (1, 2, 3):
        out.append(f"u{k} AS MATERIALIZED (SELECT site, parent AS node, s, exp(sum(ln(q))) AS up FROM (SELECT site, node, x AS s, sum(p * up) AS q FROM u{k - 1} v JOIN step ON v.s = y GROUP BY ALL) z JOIN tr USING (node) GROUP BY ALL)")
    out.append("post AS (SELECT site, s, up / sum(up) OVER (PARTITION BY site) AS p, ln(sum(up) OVER (PARTITION BY site) / k) AS lp FROM u3, size)")
    return ",\n".join(out)
