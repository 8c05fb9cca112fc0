"""A tree as a plan-time object: arrays by node, parents before children. It is as large as the list of sequences, which the
planner has to hold anyway; data by site stays in DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The most nodes that a plan-time tree may have; larger ones stay rows (``cladeframe.operators.trees``).
MAX_NODES = 1_000_000


@dataclass(frozen=True)
class Tree:
    labels: tuple[str, ...]
    parents: tuple[int, ...]
    dists: tuple[float, ...]

    @property
    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for i, p in enumerate(self.parents):
            if p >= 0:
                out[p].append(i)
        return out

    @property
    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def rows(self, spark: SparkSession, name: str = "tree") -> DataFrame:
        return spark.createDataFrame([(name, i, None if p < 0 else p, lab, d) for i, (lab, p, d) in enumerate(zip(self.labels, self.parents, self.dists))], "tree string, node long, parent long, label string, dist double")


def parse(text: str) -> Tree:
    """A Newick string. Inner nodes without a name are numbered N0, N1, ... depth first."""
    labels: list[str] = []
    parents: list[int] = []
    dists: list[float] = []
    at, stack = -1, []
    fresh = True
    for token in re.findall(r"\(|\)|,|;|:[^,();]+|'[^']*'|[^,():;\s]+", text):
        if token == "(" or (fresh and token not in "),;" and token[0] != ":"):
            if len(labels) >= MAX_NODES:
                raise ValueError("the tree is too large for a plan")
            labels.append("")
            parents.append(stack[-1] if stack else -1)
            dists.append(0.0)
            at = len(labels) - 1
        if token == "(":
            stack.append(at)
            fresh = True
        elif token == ",":
            fresh = True
        elif token == ")":
            at, fresh = stack.pop(), False
        elif token == ";":
            break
        elif token[0] == ":":
            dists[at] = float(token[1:])
        else:
            labels[at], fresh = token.strip("'"), False
    if stack or not labels:
        raise ValueError("not a tree")
    k = 0
    inner = set(parents)
    for i in range(len(labels)):
        if i in inner:
            labels[i] = labels[i] or f"N{k}"
            k += 1
    return Tree(tuple(labels), tuple(parents), tuple(dists))


def newick(tree: Tree) -> str:
    kids = tree.children
    out: dict[int, str] = {}
    for i in reversed(range(len(tree.labels))):
        inner = "(" + ",".join(out.pop(c) for c in kids[i]) + ")" if kids[i] else ""
        out[i] = f"{inner}{tree.labels[i]}:{tree.dists[i]:g}"
    return out[0] + ";"
