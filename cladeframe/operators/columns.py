"""Dynamic programs along a tree over many sites at once: a site's states travel as one row, batches of sites as arrays.

Nodes are visited one after the other, children before parents (a tree lists parents first), and each visit is a few array operations over all
sites of a slice. A slice holds as many sites as keep its arrays within CELLS numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.plans.tree import Tree

CELLS = 1 << 21
#: Scores that agree to so many digits are ties.
DIGITS = 9


def gathered(sites: DataFrame) -> DataFrame:
    """site and ``seen``: its rows' leaves and states, at most a row a leaf of use. Of a leaf's repeated rows the last state in order counts; a null site is a site of its own."""
    return sites.groupBy(F.col("site").cast("long").alias("site")).agg(F.sort_array(F.collect_list(F.struct(F.col("leaf").cast("string").alias("leaf"), F.col("state").cast("string").alias("state")))).alias("seen"))


def slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Slices of so many sites that ``cells`` numbers a site stay within CELLS."""
    size = max(1, CELLS // max(1, cells))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _flat(part: pa.RecordBatch, tree: Tree, column: str = "seen", key: str = "leaf") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all rows of known nodes: the site's place in the slice, the node's number, the state."""
    seen = part.column(column)
    flat = seen.flatten()
    site = np.repeat(np.arange(len(seen)), np.diff(np.asarray(seen.offsets)))
    node = np.asarray(pc.fill_null(pc.index_in(flat.field(key), value_set=pa.array(tree.labels, pa.string())), -1), dtype=np.int64)
    ok = node >= 0
    return site[ok], node[ok], flat.field("state").filter(pa.array(ok))


def coded(part: pa.RecordBatch, tree: Tree, alphabet: tuple[str, ...]) -> np.ndarray:
    """(sites, nodes): the number of each node's state in the alphabet, -1 where it has none."""
    site, node, state = _flat(part, tree)
    out = np.full((part.num_rows, len(tree.labels)), -1)
    out[site, node] = np.asarray(pc.fill_null(pc.index_in(state, value_set=pa.array(alphabet, pa.string())), -1), dtype=np.int64)
    return out


def with_default(codes: np.ndarray, part: pa.RecordBatch, tree: Tree, code: int) -> np.ndarray:
    """``codes`` with a number for the leaves that have no row; those with a null or unknown state stay unknown."""
    site, node, _ = _flat(part, tree)
    silent = np.zeros(codes.shape, bool)
    silent[:, tree.leaves] = True
    silent[site, node] = False
    return np.where(silent, code, codes)


def own_states(part: pa.RecordBatch, tree: Tree, default: str | None = None) -> tuple[np.ndarray, list[list[str]]]:
    """(sites, nodes): the number of each leaf's state among those of its site, in order; -1 where unknown. And those states by site. Leaves without a row
    have the state ``default``, if given, in sites that have rows at all."""
    site, node, state = _flat(part, tree)
    told = np.zeros((part.num_rows, len(tree.labels)), bool)
    told[site, node] = True
    state = np.asarray(state.to_pandas(), dtype=object)
    there = np.array([s is not None for s in state], bool)
    site, node, state = site[there], node[there], state[there]
    if default is not None:
        leaves = np.array(tree.leaves)
        s, n = np.nonzero(~told[:, leaves])
        site, node, state = np.concatenate([site, s]), np.concatenate([node, leaves[n]]), np.concatenate([state, np.full(len(s), default, object)])
    codes = np.full(told.shape, -1)
    names: list[list[str]] = [[] for _ in range(part.num_rows)]
    if not len(site):
        return codes, names
    number, kinds = pd.factorize(state, sort=True)
    pair, inverse = np.unique(site * len(kinds) + number, return_inverse=True)
    owner = pair // len(kinds)
    first = np.searchsorted(owner, np.arange(part.num_rows))
    codes[site, node] = (np.arange(len(pair)) - first[owner])[inverse]
    for s, k in zip(owner.tolist(), (pair % len(kinds)).tolist()):
        names[s].append(kinds[k])
    return codes, names


def used_states(names: list[list[str]]) -> np.ndarray:
    """(sites, states): which numbers stand for a state of the site."""
    size = np.array([len(x) for x in names])
    return np.arange(max(1, size.max(initial=0)))[None, :] < size[:, None]


def parts(names: list[list[str]], nodes: int) -> Iterator[np.ndarray]:
    """The places of the sites that have any state, in groups whose (nodes, sites, states) stay within CELLS."""
    size = np.array([len(x) for x in names])
    told = np.flatnonzero(size)
    told = told[np.argsort(size[told], kind="stable")]
    while len(told):
        most = np.maximum.accumulate(size[told]) * np.arange(1, len(told) + 1) * nodes
        n = max(1, int(np.searchsorted(most, CELLS, "right")))
        yield told[:n]
        told = told[n:]


def most_parsimonious(codes: np.ndarray, tree: Tree, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, sites, states): whether a node has the state in some assignment with the fewest changes; and those changes by site."""
    n, kids = len(tree.labels), tree.children
    cost = np.zeros((n, *used.shape), np.float32)
    cost[:, ~used] = np.inf
    state = np.arange(used.shape[1])[None, :]
    for i in range(n):
        if not kids[i]:
            known = codes[:, i] >= 0
            cost[i][known[:, None] & (state != codes[:, i][:, None])] = np.inf
    for i in reversed(range(1, n)):
        cost[tree.parents[i]] += np.minimum(cost[i], cost[i].min(axis=1, keepdims=True) + 1)
        cost[tree.parents[i]][~used] = np.inf
    least = cost[0].min(axis=1)
    best = np.zeros(cost.shape, bool)
    best[0] = (cost[0] == least[:, None]) & used
    for i in range(1, n):
        # From a parent's state s the least is min(own cost of s, least of all + 1): s itself if that is it, any of the least if the step is.
        above, low = best[tree.parents[i]], cost[i].min(axis=1, keepdims=True)
        stays = above & (cost[i] <= low + 1)
        leaves = (above & (cost[i] >= low + 1)).any(axis=1)[:, None]
        best[i] = stays | (leaves & (cost[i] == low) & used)
    return best, least


def most_probable(codes: np.ndarray, tree: Tree, steps: list[np.ndarray], start: np.ndarray, present: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sites, nodes): the jointly most probable states, ties to the smaller number; and the log-likelihood by site.

    ``steps``: log transition matrices by node, from parent to it; ``start``: log frequencies. With ``present`` (sites, nodes), states pass only between nodes that
    are both there: each group of connected nodes is a tree of its own, with its own root; the log-likelihood is their sum.
    """
    (sites, n), k = codes.shape, len(start)
    up = np.zeros((n, sites, k))
    for i in range(n):
        known = codes[:, i] >= 0
        up[i][known[:, None] & (np.arange(k)[None, :] != codes[:, i][:, None])] = -np.inf
    choice = np.zeros((n, sites, k), np.int32)
    linked = [None] + [None if present is None else present[:, i] & present[:, tree.parents[i]] for i in range(1, n)]
    for i in reversed(range(1, n)):
        both = steps[i][None, :, :] + up[i][:, None, :]
        choice[i] = both.round(DIGITS).argmax(axis=2)
        message = both.max(axis=2)
        up[tree.parents[i]] += message if linked[i] is None else np.where(linked[i][:, None], message, 0)
    state = np.zeros((sites, n), np.int64)
    total = np.zeros(sites)
    every = np.arange(sites)
    for i in range(n):
        own = start + up[i]
        root = own.round(DIGITS).argmax(axis=1)
        if i == 0:
            state[:, 0] = root
            total += own.max(axis=1) if present is None else np.where(present[:, 0], own.max(axis=1), 0)
            continue
        below = choice[i][every, state[:, tree.parents[i]]]
        if linked[i] is None:
            state[:, i] = below
        else:
            state[:, i] = np.where(linked[i], below, root)
            total += np.where(present[:, i] & ~linked[i], own.max(axis=1), 0)
    return state, total


def most_probable_recoded(codes: np.ndarray, tree: Tree, times: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`most_probable` under equal rates between the states of each site."""
    (sites, n), size = codes.shape, used.sum(axis=1)
    up = np.zeros((n, *used.shape))
    up[:, ~used] = -np.inf
    number = np.arange(used.shape[1])[None, :]
    for i in range(n):
        known = codes[:, i] >= 0
        up[i][known[:, None] & (number != codes[:, i][:, None])] = -np.inf
    choice = np.zeros(up.shape, np.int32)
    for i in reversed(range(1, n)):
        change = (1 - np.exp(-times[i])) / size
        same, other = np.log(1 - change * (size - 1)), np.log(np.maximum(change, 1e-300))
        best = up[i].round(DIGITS).argmax(axis=1)[:, None]  # from any state a child either keeps it or changes to the best of all
        stay, leave = same[:, None] + up[i], (other + up[i].max(axis=1))[:, None]
        a, b = stay.round(DIGITS), leave.round(DIGITS)
        keeps = (a > b) | (number == best) | ((a == b) & (number < best))
        choice[i] = np.where(keeps, number, best)
        up[tree.parents[i]] += np.where(used, np.maximum(stay, leave), -np.inf)
    state = np.zeros((sites, n), np.int64)
    state[:, 0] = up[0].round(DIGITS).argmax(axis=1)
    for i in range(1, n):
        state[:, i] = choice[i][np.arange(sites), state[:, tree.parents[i]]]
    return state, up[0].max(axis=1) - np.log(size)


def posterior(codes: np.ndarray, tree: Tree, steps: list[np.ndarray], start: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
    """(sites, states): the distribution of a node's states given the leaves'; and the log-likelihood by site."""
    (sites, n), k, kids = codes.shape, len(start), tree.children
    up, message, scale = np.ones((n, sites, k)), np.ones((n, sites, k)), np.zeros(sites)
    for i in range(n):
        known = codes[:, i] >= 0
        up[i][known] = np.eye(k)[codes[known, i]]
    for i in reversed(range(1, n)):
        message[i] = up[i] @ steps[i].T
        above = up[tree.parents[i]]
        above *= message[i]
        top = above.max(axis=1)
        low = (top < 1e-100) & (top > 0)
        above[low] /= top[low, None]
        scale[low] += np.log(top[low])
    down = np.tile(np.asarray(start, float), (sites, 1))
    total = np.log((down * up[0]).sum(axis=1)) + scale
    path = [node]
    while tree.parents[path[-1]] >= 0:
        path.append(tree.parents[path[-1]])
    for parent, child in zip(path[::-1], path[::-1][1:]):
        for c in kids[parent]:
            if c != child:
                down = down * message[c]
        down = down @ steps[child]
        down /= np.maximum(down.max(axis=1, keepdims=True), 1e-300)
    p = down * up[node]
    return p / p.sum(axis=1, keepdims=True), total


def rows(part: pa.RecordBatch, tree: Tree, nodes: list[int], names: np.ndarray, value: np.ndarray, kind: pa.DataType, label: str, there: np.ndarray | None = None) -> pa.RecordBatch:
    """site, node, state and a value by site, for each of the nodes (that is ``there``). ``names``: (sites, nodes) states as text."""
    s, j = np.nonzero(np.ones((part.num_rows, len(nodes)), bool) if there is None else there[:, nodes])
    node = np.array([tree.labels[i] for i in nodes], object)
    return pa.RecordBatch.from_arrays([part.column("site").take(pa.array(s)), pa.array(node[j], pa.string()), pa.array(names[s, np.array(nodes)[j]], pa.string()), pa.array(value[s].astype(kind.to_pandas_dtype()), kind)], names=["site", "node", "state", label])
