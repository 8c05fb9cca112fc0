"""Mixing sources to target weights: hash-random keys, range sort within sources, distributed prefix sums, an exact cut.

All DataFrame operations. Rows are never sorted or shuffled as a whole: word counts are summed per source
and key range, prefix sums over those few sums find the range that holds each source's cut, and only the
rows of that one range (1/4096 of a source) are range-sorted, with prefix sums over the sorted ranges. Every other row
is in or out by its range. No step has all sources, or one source's rows, in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm.common import checkpointed, n_words
from cladeframe.operators.scans import scanned

#: The weights that sources take in turn, the mix's share of all sizes, and how often a document may be taken.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Hexadecimal digits of the key that name its range: 16^3 ranges a source.
RANGE_DIGITS = 3
#: Up to so many sources (a row of about 100 bytes each) the cuts are broadcast; beyond, they are joined by source.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size), one row a source, with weight and target.

    Sources by code point, null last, take the weights in turn. ``share`` times all sizes is dealt out by
    weight; a target stops at ``most`` times its source's size and what is left over is dealt out again among
    the others. That is the level L at which sum(min(most * size, L * weight)) is what is to be dealt out: with
    sources by most * size / weight, the first k are full and L follows from prefix sums, which are taken over ranges of
    sources. A source of size 0 has target 0.
    """
    x = sizes.select("source", "source_size", F.col("source").isNull().alias("last"))
    x = scanned(x, [], ["last", "source"], k=("sum", F.lit(1), False))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    x = x.withColumn("weight", w).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    x = scanned(x, [], ["fill", "last", "source"], full=("sum", "cap", False), below=("sum", "weight", False))
    total = x.agg(F.sum("weight").alias("all_weight"), (F.sum("source_size") * F.lit(share)).alias("total"))
    x = x.crossJoin(F.broadcast(total)).withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_weight") - F.col("below")))  # one row
    level = x.agg(F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("fill", "last", "source"))).alias("the_level"))
    x = x.crossJoin(F.broadcast(level))  # one row
    return x.select("source", "source_size", "weight", F.when(F.col("the_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("the_level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, cut: str = "words", seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with size, source_size, target and taken: how many words of each document the mix takes.

    A source whose target is q times its size and a rest takes each document q times, and once more those that
    come first by md5(seed, id), up to the rest. ``cut="words"`` takes the first words only of the document in
    which the rest ends, so that a source's taken words are its target rounded down; ``cut="documents"`` takes
    that document whole if at least half of it lies within the rest, so all are whole.

    Null texts have size 0 and take 0. A null source is a source of its own. Null ids are ordered by the
    text alone; equal keys by id, then by the text's first 64 characters and hash: reruns agree, and among rows alike in id, text and source it
    doesn't matter which is taken. An empty table gives an empty table. Columns of the four names are replaced; all
    others are kept, whatever they are called.
    """
    if cut not in ("words", "documents"):
        raise ValueError(cut)
    names = docs.columns
    # The table's own columns go by their places, so that none can clash with what is made here.
    own = {c: f"c{i}" for i, c in reversed(list(enumerate(names)))}
    doc_id, text, source = (F.col(own[c]) for c in (id_col, text_col, source_col))
    base = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("size", n_words(text)).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))))
    base = base.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    # Sums by source and key range: summed before the shuffle, at most 4096 rows a source and task.
    sums = checkpointed(base.groupBy(source.alias("source"), "range").agg(F.sum("size").alias("n")))
    wanted = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), share, most, weights)
    wanted = wanted.withColumn("whole", F.floor(F.col("target"))).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(F.lit(0))).withColumn("rest", F.col("whole") - F.col("times") * F.col("source_size"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows a source
    # The range that holds the cut: the last that starts at or before the rest's end.
    at = before.alias("b").join(wanted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source"))).where("before < rest").groupBy(F.col("w.source").alias("source")).agg(F.max(F.struct("range", "before")).alias("cut"))
    plan = wanted.alias("w").join(at.alias("a"), F.col("w.source").eqNullSafe(F.col("a.source")), "left").select(F.col("w.source").alias("source"), F.col("w.source_size").alias("source_size"), F.col("w.target").alias("target"), "times", "rest", "cut")
    plan = checkpointed(plan)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    x = base.join(plan, source.eqNullSafe(F.col("source")), "left").withColumn("place", F.when(F.col("cut").isNull() | (F.col("range") > F.col("cut.range")), 1).when(F.col("range") < F.col("cut.range"), -1).otherwise(0))
    # The cuts' ranges, sorted over many partitions; a number apart for rows alike in all that orders them.
    inside = checkpointed(x.where("place = 0").withColumns({"first": F.substring(text, 1, 64), "hash": F.xxhash64(text), "apart": F.monotonically_increasing_id()}))
    inside = scanned(inside, ["source"], ["key", own[id_col], "first", "hash", "apart"], inner=("sum", "size", False))
    left = F.col("rest") - F.col("cut.before") - F.col("inner")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left)) if cut == "words" else F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    outside = x.where("place <> 0").withColumn("extra", F.when(F.col("place") < 0, F.col("size")).otherwise(0).cast("long"))
    rows = inside.withColumn("extra", part.cast("long")).select(outside.columns).unionByName(outside)
    made = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("times") * F.col("size") + F.col("extra")}
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in made), *(c.alias(n) for n, c in made.items()))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document of ``mix(cut="documents")`` as often as it is taken, none for 0 (nor for 0 words)."""
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    return mixed.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.explode(F.array_repeat(F.lit(True), n)).alias("turn")).drop("turn").toDF(*kept)
