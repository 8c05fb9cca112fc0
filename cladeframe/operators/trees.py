"""Operators on trees kept as rows (tree, node, parent, label, dist); a root has no parent.

Everything doubles the reach of pointers to ancestors each round until all have come to their roots, so a tree of depth d takes log2(d)
rounds whatever d is, each cut off by a reliable checkpoint. Sums and marks travel with the pointers: no operator but :func:`closure`
lists pairs of nodes and ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.plans.session import checkpointed


def lifted(tree: DataFrame) -> list[DataFrame]:
    """Round k: tree, node, up (the ancestor 2^k steps above; null where the root is nearer), steps and dist (to ``up``, or to the root). The last has no
    ``up`` left. A parent that the tree lacks ends a path as a root does. Raises ValueError if parents form a cycle."""
    known = tree.select("tree", F.col("node").alias("up")).distinct()
    there = tree.where("parent IS NOT NULL").join(known.withColumnRenamed("up", "parent"), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.coalesce(F.col("dist").cast("double"), F.lit(0.0)).alias("dist"))
    top = tree.join(there.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", F.lit(None).cast(dict(tree.dtypes)["node"]).alias("up"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("dist"))
    rounds, step, most = [checkpointed(there.unionByName(top).dropDuplicates(["tree", "node"]))], 1, None
    while not rounds[-1].where("up IS NOT NULL").isEmpty():
        most = rounds[0].count() if most is None else most
        if step > most:
            raise ValueError("parents form a cycle")
        s = rounds[-1]
        more = s.select("tree", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("dist").alias("__dist"))
        rounds.append(checkpointed(s.join(more, ["tree", "up"], "left").select("tree", "node", F.col("__up").alias("up"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), (F.col("dist") + F.coalesce("__dist", F.lit(0.0))).alias("dist"))))
        step *= 2
    return rounds


def closure(tree: DataFrame) -> DataFrame:
    """tree, node, anc, steps, dist: every ancestor of every node, itself (0 steps) included. As many rows as nodes times their depths."""
    found = tree.select("tree", "node", F.col("node").alias("anc"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("dist"))
    for s in lifted(tree)[:-1]:
        j = s.where("up IS NOT NULL").select("tree", F.col("node").alias("anc"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("dist").alias("__dist"))
        found = found.unionByName(found.join(j, ["tree", "anc"]).select("tree", "node", F.col("__up").alias("anc"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("dist") + F.col("__dist")).alias("dist")))
    return found


def with_depth(tree: DataFrame) -> DataFrame:
    """The tree with ``depth`` (root 0) and ``root_dist``."""
    end = lifted(tree)[-1].select("tree", "node", F.col("steps").cast("int").alias("depth"), F.col("dist").alias("root_dist"))
    return tree.join(end, ["tree", "node"])


def leaves(tree: DataFrame) -> DataFrame:
    inner = tree.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    return tree.join(inner, ["tree", "node"], "left_anti")


def leaf_counts(tree: DataFrame) -> DataFrame:
    """tree, node, n_leaves below (a leaf has itself). Leaves nearer than 2^k steps are those nearer than half of that, of the node and of the nodes
    half of that below."""
    n = leaves(tree).select("tree", "node", F.lit(1).cast("long").alias("n_leaves"))
    for s in lifted(tree)[:-1]:
        up = n.join(s.where("up IS NOT NULL"), ["tree", "node"]).select("tree", F.col("up").alias("node"), "n_leaves")
        n = checkpointed(n.unionByName(up).groupBy("tree", "node").agg(F.sum("n_leaves").alias("n_leaves")))
    return n


def subtree(tree: DataFrame, root: DataFrame) -> DataFrame:
    """The rows at or below the nodes of ``root`` (tree, node); those become roots."""
    mark = root.select("tree", "node").distinct()
    for s in lifted(tree)[:-1]:  # whose ancestor of 2^k steps is marked is marked, nearer ancestors first
        below = s.join(mark.withColumnRenamed("node", "up"), ["tree", "up"], "left_semi").select("tree", "node")
        mark = checkpointed(mark.unionByName(below).distinct())
    top = root.select("tree", "node").distinct().withColumn("__top", F.lit(True))
    x = tree.join(mark, ["tree", "node"], "left_semi").join(top, ["tree", "node"], "left")
    return x.withColumn("parent", F.when(F.col("__top").isNull(), F.col("parent"))).drop("__top")


def pruned(tree: DataFrame, gone: DataFrame) -> DataFrame:
    """The tree without the nodes of ``gone`` (tree, node) and without inner nodes that have no kept leaf below; orphans are roots."""
    kept = tree.join(gone.select("tree", "node"), ["tree", "node"], "left_anti")
    alive = checkpointed(kept.join(leaves(tree).select("tree", "node"), ["tree", "node"], "left_semi").select("tree", "node"))
    for s in lifted(kept)[:-1]:
        up = s.where("up IS NOT NULL").join(alive, ["tree", "node"], "left_semi").select("tree", F.col("up").alias("node"))
        alive = checkpointed(alive.unionByName(up).distinct())
    x = kept.join(alive, ["tree", "node"], "left_semi")
    have = x.select("tree", F.col("node").alias("parent"), F.lit(True).alias("__has"))
    return x.join(have, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("__has"), F.col("parent"))).drop("__has")


def relabelled(tree: DataFrame) -> DataFrame:
    """Inner nodes get N0, N1, ... in node order within their tree."""
    inner = tree.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct().withColumn("__k", F.row_number().over(W.partitionBy("tree").orderBy("node")) - 1)
    return tree.join(inner, ["tree", "node"], "left").withColumn("label", F.when(F.col("__k").isNotNull(), F.concat(F.lit("N"), "__k")).otherwise(F.col("label"))).drop("__k")


def leaf_distances(tree: DataFrame) -> DataFrame:
    """tree, node, d: each leaf's distance to its root."""
    return lifted(tree)[-1].join(leaves(tree).select("tree", "node"), ["tree", "node"], "left_semi").select("tree", "node", F.col("dist").alias("d"))


def leaf_paths(tree: DataFrame) -> DataFrame:
    """tree, node (a leaf), anc, dist: the length of every branch on each leaf's way to its root, its own included: a leaf-by-branch matrix as rows."""
    branch = tree.select("tree", F.col("node").alias("anc"), "dist")
    return closure(tree).join(leaves(tree).select("tree", "node"), ["tree", "node"], "left_semi").select("tree", "node", "anc").join(branch, ["tree", "anc"]).select("tree", "node", "anc", "dist")


def with_leaf_paths(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """The tree with the branch lengths of ``paths`` (as :func:`leaf_paths` gives them). Branches that no path has keep theirs; of several lengths the
    largest is taken."""
    told = paths.groupBy("tree", F.col("anc").alias("node")).agg(F.max("dist").alias("__d"))
    return tree.join(told, ["tree", "node"], "left").withColumn("dist", F.coalesce("__d", "dist")).drop("__d")


def rescaled(tree: DataFrame, target: float) -> DataFrame:
    """Distances multiplied so that the mean leaf-to-root distance is ``target``; null where that mean is 0."""
    m = leaf_distances(tree).groupBy("tree").agg(F.avg("d").alias("__m"))
    return tree.join(m, "tree").withColumn("dist", F.try_divide(F.col("dist") * target, F.col("__m"))).drop("__m")


def leaf_root_distribution(tree: DataFrame) -> DataFrame:
    """Mean and population variance of leaves' distances to the root."""
    return leaf_distances(tree).groupBy("tree").agg(F.avg("d").alias("mean"), F.var_pop("d").alias("variance"))


def integrity_issues(tree: DataFrame, alignment: DataFrame) -> DataFrame:
    """issue and name: duplicate labels on either side, and names that only one side has."""
    lv = leaves(tree).select(F.col("label").alias("name"))
    names = alignment.select("name")
    twice = lambda d, what: d.groupBy("name").count().where("count > 1").select(F.lit(what).alias("issue"), "name")
    only = lambda a, b, what: a.join(b, "name", "left_anti").distinct().select(F.lit(what).alias("issue"), "name")
    return twice(lv, "duplicate in tree").unionByName(twice(names, "duplicate in alignment")).unionByName(only(names, lv, "missing in tree")).unionByName(only(lv, names, "missing in alignment"))
