"""Sharding by histogram sort: near-equal bytes in every shard, one exchange.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie together and can still be cut.
The key space is a tree of 4096-way histograms: exact bytes and rows below candidate boundaries are counted
across all partitions, and only the cells that hold a wanted splitter, or more bytes than one task should sort, are probed
again with finer boundaries, until all meet the tolerance. Then rows go to their place in one exchange.
What the driver holds is the histograms of the probed cells: bounded by shards and by a few cells for each RUN_BYTES of input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm.common import checkpointed

#: Bits that a histogram level adds to the key prefix, at most and at least.
BITS, LEAST_BITS = 12, 4
#: A splitter may miss its place by this share of a shard's bytes. A run of keys, which one task sorts, holds at most this share of a shard and at most so
#: many bytes, whatever the input; the driver holds a few dozen bytes for each run and cell, and there are a few for each RUN_BYTES of the input.
TOLERANCE, RUN_SHARE, RUN_BYTES = 0.001, 1 / 8, 256 << 20


def _digit(used: int, bits: int) -> Column:
    """The key's digit after ``used`` bits: ``bits`` of the first or second hash, from the top."""
    which, at = divmod(used, 64)
    return F.shiftrightunsigned(F.col("__h1" if which == 0 else "__h2"), 64 - at - bits).bitwiseAND((1 << bits) - 1)


def _prefix(used: int) -> list[Column]:
    """The key's part above a level, as columns to group by."""
    which, at = divmod(used, 64)
    h1 = F.col("__h1") if which else F.shiftrightunsigned(F.col("__h1"), 64 - at) if at else F.lit(0)
    h2 = F.shiftrightunsigned(F.col("__h2"), 64 - at) if which and at else F.lit(0)
    return [h1.cast("long").alias("p1"), h2.cast("long").alias("p2")]


def histogram_splits(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE, run_bytes: int = RUN_BYTES) -> pd.DataFrame:
    """Runs of keys in order: first key (h1, h2 as unsigned), bytes, rows, shard, the slot of the first row, and where a run of equal
    keys is dealt out by number (``alike``), a row for each of its shards with the number it begins with (``first``).

    ``keys``: __h1, __h2, __size. Each level counts, for the cells still to be refined, bytes and rows by the
    next digit: one grouped aggregation, summed before the shuffle. Few cells (those that hold a splitter or a hot text) are refined by
    BITS at once, many by as many as bring their mean below a run.
    """
    done: list[tuple[int, int, int, int]] = []  # first h1, first h2, bytes, rows
    todo: list[tuple[int, int]] = [(0, 0)]
    total, used, bits = None, 0, BITS
    spark = keys.sparkSession
    while todo and used < 128:
        which, at_bit = divmod(used, 64)
        bits = min(bits, 64 - at_bit)
        cells = keys
        if total is not None:  # at most a few cells for each run's worth of bytes
            asked = pa.table({"p1": pa.array([_signed(a) for a, _ in todo], pa.int64()), "p2": pa.array([_signed(b) for _, b in todo], pa.int64())})
            cells = keys.join(F.broadcast(spark.createDataFrame(asked)), [c == F.col(n) for c, n in zip(_prefix(used), ("p1", "p2"))], "left_semi")
        rows = cells.groupBy(*_prefix(used), _digit(used, bits).alias("d")).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows")).toArrow()
        found = []
        for p1, p2, d, n_bytes, n_rows in zip(*(rows.column(c).to_pylist() for c in ("p1", "p2", "d", "bytes", "rows"))):
            a, b = p1 % 2**64, p2 % 2**64
            a, b = (a << bits | d, 0) if which == 0 else (a, b << bits | d)
            found.append((a << 64 - at_bit - bits if which == 0 else a, b << 64 - at_bit - bits if which else 0, n_bytes, n_rows, a, b))
        if total is None:
            total = sum(x[2] for x in found)
            shard = max(1.0, total / n_shards)
        used += bits
        # Where each cell begins among all bytes: cells that are done and those just counted, in key order.
        every = sorted([(*x, None, None) for x in done] + found)
        at, done, todo, heavy = 0, [], [], 0
        for h1, h2, n_bytes, n_rows, a, b in every:
            cut = int(at / shard) != int((at + n_bytes) / shard) and n_bytes > tolerance * shard
            if a is not None and n_rows > 1 and used < 128 and (cut or n_bytes > _run_limit(shard, run_bytes)):
                todo.append((a, b))
                heavy += n_bytes
            else:
                done.append((h1, h2, n_bytes, n_rows))
            at += n_bytes
        few = len(todo) <= 4 * n_shards
        bits = BITS if few else min(BITS, max(LEAST_BITS, 1 + math.ceil(math.log2(max(1.0, heavy / len(todo) / _run_limit(shard, run_bytes))))))
    return _placed(done, n_shards, tolerance, run_bytes)


def _run_limit(shard: float, run_bytes: int) -> float:
    return min(RUN_SHARE * shard, run_bytes)


def _signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def _placed(runs: list[tuple[int, int, int, int]], n_shards: int, tolerance: float, run_bytes: int) -> pd.DataFrame:
    """Shards and slots: a run goes to the shard in which its middle byte lies. Runs that are still too large or cut hold one key only:
    each of their rows, all of one size, goes to the shard of its own middle byte."""
    runs = sorted(runs)
    total, at, slots, out = max(1, sum(x[2] for x in runs)), 0, [0] * n_shards, []
    share = max(1.0, total / n_shards)
    for h1, h2, n_bytes, n_rows in runs:
        cut = int(at / share) != int((at + n_bytes) / share) and n_bytes > tolerance * share
        alike = n_rows > 1 and (cut or n_bytes > _run_limit(share, run_bytes))
        parts = [(0, n_rows, min(n_shards - 1, int((at + n_bytes / 2) * n_shards / total)))]
        if alike:
            parts, first, each = [], 0, n_bytes / n_rows
            for s in range(min(n_shards - 1, int(at / share)), n_shards):
                end = n_rows if s == n_shards - 1 else min(n_rows, max(first, math.ceil(((s + 1) * share - at) / each - 0.5)))
                if end > first:
                    parts.append((first, end, s))
                first = end
        for first, end, s in parts:
            out.append((h1, h2, n_bytes, n_rows, s, slots[s], alike, first))
            slots[s] += end - first
        at += n_bytes
    return pd.DataFrame(out, columns=["h1", "h2", "bytes", "rows", "shard", "slot", "alike", "first"])


def row_bytes(text: Column) -> Column:
    """What a row weighs: the text's UTF-8 bytes (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard(docs: DataFrame, n_shards: int, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (the row's place in its shard, gapless from 0).

    Shards' bytes are equal but for the tolerance and single rows. Order: hash of the text (null as empty), hash
    of the id (null ids have one hash in common), id; rows alike in both may stand in either order. Groups of equal texts stay together unless a shard's
    border, or a run's, lies within. Rows alike in id and text can't be told apart: where they are too many for a run, they are
    numbered in a checkpoint and dealt out by number. One task sorts at most about ``run_bytes`` of rows.
    An empty table gives an empty table. Columns named size, shard or slot are replaced, the others kept, whatever they are called.
    """
    names = docs.columns
    own = {c: f"c{i}" for i, c in reversed(list(enumerate(names)))}  # by place, so that no name can clash
    text, doc_id = own[text_col], own[id_col]
    keyed = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("__size", row_bytes(F.col(text))).withColumn("__h1", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("__h2", F.xxhash64(F.col(doc_id)))
    runs = histogram_splits(checkpointed(keyed.select("__h1", "__h2", "__size")), n_shards, tolerance, run_bytes)
    parts = runs.assign(run=(~runs.duplicated(["h1", "h2"])).cumsum() - 1)
    runs = runs.drop_duplicates(["h1", "h2"])
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((runs["h1"].to_numpy(dtype=np.uint64), runs["h2"].to_numpy(dtype=np.uint64), runs["alike"].to_numpy(dtype=bool)))

    @F.pandas_udf("int")
    def run_of(a: pd.Series, b: pd.Series) -> pd.Series:
        """The run's number; -1 less it for runs that are dealt out by number."""
        h1, h2, alike = table.value
        a, b = a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)
        lo, hi = np.searchsorted(h1, a, "left"), np.searchsorted(h1, a, "right")
        out = hi - 1
        for k in np.flatnonzero(hi - lo >= 1):  # runs that begin at this very hash: the second hash decides
            out[k] = lo[k] - 1 + np.searchsorted(h2[lo[k] : hi[k]], b[k], "right")
        return pd.Series(np.where(alike[out], -1 - out, out).astype(np.int32)) if len(out) else pd.Series([], dtype=np.int32)

    x = keyed.withColumn("__run", run_of("__h1", "__h2"))
    places = spark.createDataFrame(pa.table({"__run": pa.array(np.where(parts["alike"], -1 - parts["run"], parts["run"]), pa.int32()), "__shard": pa.array(parts["shard"], pa.int32()), "__slot": pa.array(parts["slot"], pa.int64()), "__first": pa.array(parts["first"], pa.int64())}))
    # One row a run (and shard): a few dozen bytes for each RUN_BYTES of the input.
    out = x.where("__run >= 0").join(F.broadcast(places.drop("__first")), "__run")
    out = out.withColumn("__slot", F.col("__slot") + F.row_number().over(W.partitionBy("__run").orderBy("__h1", "__h2", doc_id)) - 1)
    if parts["alike"].any():
        out = out.unionByName(_dealt(x.where("__run < 0"), places.where("__run < 0")))
    made = {"size": "__size", "shard": "__shard", "slot": "__slot"}
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in made), *(F.col(c).alias(n) for n, c in made.items()))


def _dealt(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of runs of equal keys with shard and slot: numbered within each input partition, partitions one after the other."""
    kept = checkpointed(rows.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    counts = kept.groupBy("__run", "__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__run", "__part").collect()
    starts, at = [], {}
    for r in counts:
        starts.append((r["__run"], r["__part"], at.get(r["__run"], 0)))
        at[r["__run"]] = at.get(r["__run"], 0) + r["n"]
    x = kept.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "__run int, __part long, __start long")), ["__run", "__part"])
    x = x.withColumn("__n", F.col("__start") + F.row_number().over(W.partitionBy("__run", "__part").orderBy("__id")) - 1)
    # The last place that begins at or before the number.
    found = places.groupBy("__run").agg(F.sort_array(F.collect_list(F.struct("__first", "__shard", "__slot"))).alias("__places"))
    x = x.join(F.broadcast(found), "__run").withColumn("__place", F.element_at(F.filter("__places", lambda p: p["__first"] <= F.col("__n")), -1))
    x = x.withColumn("__shard", F.col("__place.__shard")).withColumn("__slot", F.col("__place.__slot") + F.col("__n") - F.col("__place.__first"))
    return x.drop("__id", "__part", "__start", "__n", "__places", "__place")
