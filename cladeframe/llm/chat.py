"""Chat formatting: reply trees to conversations, native DataFrame operations throughout.

Root-to-leaf paths are enumerated by iterative self-joins on (tree, node) pairs alone, without texts: each
round doubles the length of the known ancestor chains, so a tree of depth d takes log2(d) rounds. Scores are summed
along the way, branches ranked by them, and only chosen paths are spelt out; the texts join once, and each path becomes one formatted string
with the spans of its assistant texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm.common import checkpointed

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """A text in which no control string can occur: & and <| written as entities; :func:`unescaped` is its inverse."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def escaped_role(role: Column) -> Column:
    """As :func:`escaped`, and on one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped(text: Column) -> Column:
    for entity, plain in (("&#10;", "\n"), ("&lt;|", "<|"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def linear_parents(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of plain conversations as reply trees of one branch: adds node (place by turn, from 0) and parent
    (the place before; null for the first), in place of columns of these names. Repeated turns follow each other by role and text. Null turns come first."""
    w = W.partitionBy(tree).orderBy(turn, "role", "text")
    node = (F.row_number().over(w) - 1).cast("long")
    return rows.withColumn("node", node).withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))


def paths(nodes: DataFrame, tree: str = "conv_id", node: str = "node", parent: str = "parent", score: str | None = None, top: int | None = None) -> DataFrame:
    """Root-to-leaf paths, a row for each of their nodes: tree, leaf, node, depth (root 0), path_score, path_rank.

    A path's score is the sum of its nodes' scores (null or no column: 0); a tree's paths rank by it from 1, the
    highest first, ties to the smaller leaf. ``top`` keeps the first so many of each tree. A node whose parent
    is null or missing from the tree is a root. (tree, node) pairs should be distinct: of repeated ones the least parent
    counts. Nodes on a cycle reach no root and have no path. Rows with a null node are left out; a null tree is one tree.
    """
    s = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    raw = nodes.where(F.col(node).isNotNull()).select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), s.alias("score"))
    raw = raw.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = raw.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    same = lambda a, b: a["tree"].eqNullSafe(b["t"])
    edges = raw.join(known, same(raw, known) & (raw["parent"] == known["n"]), "left").select("tree", "node", F.col("n").alias("up"), "score")
    inner = edges.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = edges.join(inner, edges["tree"].eqNullSafe(inner["t"]) & (edges["node"] == inner["n"]), "left_anti")
    edges, leaves = checkpointed(edges), checkpointed(leaves.select(F.col("tree").alias("lt"), F.col("node").alias("leaf")))
    # Doubling: in round k a node knows its 2^k-th ancestor, if it has one, and the scores and steps up to there. A node that has come to its root is done:
    # later rounds join only those that haven't.
    first = edges.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", "score", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    done, rounds = [first.where("up IS NULL")], [first.where("up IS NOT NULL")]
    longest = raw.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest and not rounds[-1].isEmpty():  # more steps than nodes: what still has an ancestor is on a cycle or leads to one
        a, b = rounds[-1].alias("a"), reduce(DataFrame.unionByName, [*done, rounds[-1]]).alias("b")
        further = checkpointed(a.join(b, F.col("a.t").eqNullSafe(F.col("b.t")) & (F.col("a.up") == F.col("b.n"))).select("a.t", "a.n", "b.up", (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.steps") + F.col("b.steps")).alias("steps")))
        done.append(further.where("up IS NULL"))
        rounds.append(further.where("up IS NOT NULL"))
        step *= 2
    end = reduce(DataFrame.unionByName, done)
    ranked = leaves.join(end, F.col("lt").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n"))).select(F.col("lt").alias("tree"), "leaf", F.col("score").alias("path_score"), F.col("steps").alias("length"))
    ranked = ranked.withColumn("path_rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("path_rank") <= top)
    # Only chosen paths are spelt out: each round doubles the known part of them.
    found = checkpointed(ranked.select("tree", "leaf", F.col("leaf").alias("node"), F.col("length").alias("depth"), "path_score", "path_rank"))
    for k, s in enumerate(rounds[:-1]):
        jump = s.select("t", "n", "up")
        more = found.join(jump, found["tree"].eqNullSafe(jump["t"]) & (found["node"] == jump["n"])).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"), "path_score", "path_rank")
        found = checkpointed(found.unionByName(more))
    return found


def format_paths(nodes: DataFrame, chosen: DataFrame, tree: str = "conv_id", node: str = "node") -> DataFrame:
    """Each chosen path as one conversation: tree, leaf, path_score, path_rank, formatted, loss_spans; other columns of ``nodes`` play no part.

    A turn is START role newline text END newline, role and text escaped (null: empty). ``loss_spans`` are the
    spans of assistant texts in ``formatted``: start and length in code points. Of rows that repeat a (tree, node) pair,
    each is a turn of its own, in the order of role and text.
    """
    turns = nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), escaped_role(F.col("role")).alias("role"), F.col("role").alias("raw_role"), escaped(F.col("text")).alias("text"))
    rows = chosen.join(turns, chosen["tree"].eqNullSafe(turns["t"]) & (chosen["node"] == turns["n"]))
    turn = F.struct("depth", "role", "text", (F.col("raw_role") == "assistant").alias("loss"))
    grouped = rows.groupBy("tree", "leaf", "path_score", "path_rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("tree", "leaf", "path_score", "path_rank", F.concat_ws("", F.transform("turns", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n")))).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def loss_spans(turns: Column) -> Column:
    """Start and length of the assistant texts, from the lengths of what stands before them."""
    around = len(START) + 1 + len(END) + 1
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        n = F.length(x["text"]).cast("long")
        first = acc["at"] + F.length(x["role"]) + len(START) + 1
        spans = F.when(F.coalesce(x["loss"], F.lit(False)), F.concat(acc["spans"], F.array(F.struct(first.alias("start"), n.alias("length"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(x["role"]) + n + around).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def parsed(formatted: Column) -> Column:
    """Turns (role, text; unescaped) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(unescaped(F.substring_index(x, "\n", 1)).alias("role"), unescaped(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 2 - len(END))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))
