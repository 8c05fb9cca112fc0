"""LM scoring with a probabilistic suffix tree over the bytes of a text's words.

Symbols are bytes: a text is its words (A-Z in lower case) with one space between, then an end. Contexts are
the last 0 to DEPTH symbols. Counts of (context, next symbol) come from all training texts: every task counts its
distinct longest windows once, so what is shuffled is windows and not text; shorter contexts are sums of longer
ones. A context joins the tree if it is frequent enough and its smoothed next-symbol distribution diverges enough from its
parent's (likelihood-ratio gain); rare next symbols are left to the parent, with the mass that makes each
distribution sum to 1. Scoring takes the longest suffix in the tree.

The tree grows with the corpus. It is dealt by the last two symbols of the contexts, or three where two have more, to pieces of at most PIECE entries; a pass over the texts has one
piece and scores the symbols whose contexts lie in it, so a small tree is one pass and a larger one a few, without a shuffle of windows. The
word counts of the unigram base are joined, but for the words of a share of FREQUENT and more of all tokens, of which there can be no more
than 1 / FREQUENT.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm import tokens
from cladeframe.llm.common import checkpointed

#: Longest context in symbols; least count of a context and of a next symbol in it; least gain, in nats, over the parent.
DEPTH, MIN_COUNT, MIN_NEXT, MIN_GAIN = 5, 8, 2, 4.0
#: Symbols that UTF-8 doesn't use: what stands before a text, and its end.
START, END, SYMBOLS = 0xFE, 0xFF, 256
#: Entries of a piece of the tree (17 bytes each); the share of all tokens from which on a word is sent to the tasks; distinct keys that a task holds.
PIECE, FREQUENT, HELD = 4_000_000, 1e-6, 1 << 20
_SLICE = 6 << 20


def windows(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """For every symbol of every text the window of its ``depth`` predecessors and itself, packed with the symbol lowest;
    where each text's windows begin; where each text's words begin; the words."""
    flat, offsets = tokens.words(texts)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), " ").cast(pa.binary())
    framed = pc.binary_join_element_wise(pa.scalar(bytes([START]) * depth), joined, pa.scalar(bytes([END])), b"").cast(pa.large_binary())
    n = len(framed)
    ends = np.frombuffer(framed.buffers()[1], np.int64)[framed.offset : framed.offset + n + 1]
    raw = np.frombuffer(framed.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    keys = np.zeros(len(raw) - depth, np.int64)
    for j in range(depth + 1):
        keys = (keys << 8) | raw[j : len(raw) - depth + j]
    # The first `depth` bytes of a text are what stands before it and are no symbols of it.
    starts = ends[:-1] - ends[0]
    real = np.ones(len(keys), bool)
    for j in range(1, depth + 1):
        late = starts[1:] - j
        real[late[late < len(real)]] = False
    return keys[real], starts - depth * np.arange(n), offsets, flat


def _mask(symbols: int) -> int:
    return (1 << 8 * symbols) - 1


# --- counting

def window_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key and n of all windows of a column ``text``; each task's distinct windows are summed before the shuffle."""

    def emitted(keys: np.ndarray, n: np.ndarray):
        for at in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)]), pa.array(n[at : at + (1 << 18)])], names=["key", "n"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in tokens.slices(batch, "text", _SLICE):
                held.append(np.unique(windows(part.column("text"), depth)[0], return_counts=True))
                if len(held) > 4:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD:  # what is sent on early is summed after the shuffle
                        yield from emitted(*held.pop())
        if held:
            yield from emitted(*_summed(held))

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes) and c; each task's distinct words are summed before the shuffle."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for part in tokens.slices(batch, "text", _SLICE):
                counts = pc.value_counts(tokens.words(part.column("text"))[0])
                held.append(pa.table({"word": counts.field("values").cast(pa.binary()), "c": counts.field("counts")}))
                rows += len(held[-1])
                if rows > 1 << 20:
                    held = [_words_summed(held)]
                    rows = len(held[0])
                    if rows > 1 << 19:  # mostly distinct: sent on, and summed after the shuffle
                        yield from held.pop().to_batches(max_chunksize=1 << 17)
                        rows = 0
        if held:
            yield from _words_summed(held).to_batches(max_chunksize=1 << 17)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _words_summed(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])


# --- the tree

def grown(counts: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, min_next: int = MIN_NEXT, min_gain: float = MIN_GAIN) -> DataFrame:
    """The tree's rows: depth, key (context and next symbol), p, and for each context one row with key -1 - context and, as p, the
    factor by which it takes over its parent's probability of other symbols.

    Level by level: P(x|s) = (n(s,x) + t P(x|parent)) / (n(s) + t), with t distinct symbols after s (Witten-Bell);
    a context's windows are at most 256 rows, its sums windows over them. The root's parent is uniform.
    """
    above: DataFrame | None = None
    out: DataFrame | None = None
    for d in range(depth + 1):
        level = counts.groupBy(F.col("key").bitwiseAND(F.lit(_mask(d + 1))).alias("key")).agg(F.sum("n").alias("n"))
        level = level.withColumn("ctx", F.shiftrightunsigned("key", 8))
        w = W.partitionBy("ctx")
        level = level.withColumn("total", F.sum("n").over(w)).withColumn("kinds", F.count(F.lit(1)).over(w))
        if d:  # a longer context is no more frequent than its suffix, so what is dropped here has no descendants either
            level = level.where(F.col("total") >= min_count)
        if above is None:
            level = level.withColumn("q", F.lit(1 / SYMBOLS))
        else:
            level = level.join(above.select(F.col("key").alias("up"), F.col("p").alias("q")), F.col("key").bitwiseAND(F.lit(_mask(d))) == F.col("up")).drop("up")
        level = level.withColumn("p", (F.col("n") + F.col("kinds") * F.col("q")) / (F.col("total") + F.col("kinds")))
        kept = F.lit(True) if d == 0 else F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).over(w) >= min_gain
        level = level.withColumn("kept", kept).withColumn("entry", F.col("kept") & ((F.col("n") >= min_next) | F.lit(d == 0)))
        mass = lambda c: F.sum(F.when(F.col("entry"), F.col(c)).otherwise(0.0)).over(w)
        level = level.withColumn("rest", F.when(mass("q") < 1 - 1e-12, (1 - mass("p")) / (1 - mass("q"))).otherwise(0.0))
        level = checkpointed(level.select("key", "ctx", "q", "p", "kept", "entry", "rest"))
        made = level.where("entry").select(F.lit(d).alias("depth"), "key", "p").unionByName(level.where("kept").select(F.lit(d).alias("depth"), (-1 - F.col("ctx")).alias("key"), F.col("rest").alias("p")).distinct())
        out = made if out is None else out.unionByName(made)
        above = level.select("key", F.when(F.col("entry"), F.col("p")).when(F.col("kept"), F.col("rest") * F.col("q")).otherwise(F.col("q")).alias("p"))
    return out


class Tree:
    """The tree as sorted arrays by depth, for tasks."""

    def __init__(self, depths: np.ndarray, keys: np.ndarray, ps: np.ndarray, depth: int = DEPTH):
        self.levels = []
        for d in range(depth + 1):
            here = depths == d
            key, p = keys[here], ps[here]
            ctx, order = key < 0, np.argsort
            e, c = order(key[~ctx]), order(-1 - key[ctx])
            self.levels.append((key[~ctx][e], p[~ctx][e], (-1 - key[ctx])[c], p[ctx][c]))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(symbol | its longest suffix in the tree), for packed windows: from the root down, each context in the tree
        either knows the symbol or takes its share of the shorter context's probability."""
        p = np.full(len(keys), 1 / SYMBOLS)
        for d, (key, known, ctx, rest) in enumerate(self.levels):
            if not len(ctx):
                continue
            mine, above = keys & _mask(d + 1), (keys & _mask(d + 1)) >> 8
            i, j = (np.minimum(np.searchsorted(a, x), max(0, len(a) - 1)) for a, x in ((ctx, above), (key, mine)))
            inside = ctx[i] == above
            entry = inside & (key[j] == mine) if len(key) else np.zeros(len(keys), bool)
            p = np.where(entry, known[j] if len(key) else 0.0, np.where(inside, rest[i] * p, p))
        return np.log10(np.maximum(p, 1e-300))


def _collected(tree: DataFrame, depth: int) -> Tree:
    rows = tree.select(F.col("depth").cast("byte"), "key", "p").toArrow()
    return Tree(*(np.asarray(rows[c]) for c in ("depth", "key", "p")), depth)


def _context(key: Column) -> Column:
    return F.when(key < 0, -1 - key).otherwise(F.shiftrightunsigned(key, 8))


def _last_two(depth: Column, key: Column) -> Column:
    """The last two symbols of an entry's context; null for contexts that are shorter."""
    return F.when(depth >= 2, _context(key).bitwiseAND(0xFFFF)).cast("int")


def _third(depth: Column, key: Column) -> Column:
    """The symbol before those; null for contexts of two."""
    return F.when(depth >= 3, F.shiftrightunsigned(_context(key), 16).bitwiseAND(0xFF)).cast("int")


class Pieces:
    """Which piece of the tree (from 0) scores a window: by the last two symbols of its context, or the last three where those two have more than ``limit`` entries."""

    def __init__(self, tree: DataFrame, limit: int = PIECE):
        g, t = _last_two(F.col("depth"), F.col("key")).alias("g"), _third(F.col("depth"), F.col("key")).alias("t")
        rows = tree.groupBy(g).agg(F.count(F.lit(1)).alias("n")).where("g IS NOT NULL").toArrow()  # 65536 rows at most
        n = dict(zip(rows["g"].to_pylist(), rows["n"].to_pylist()))
        self.heavy = sorted(k for k, v in n.items() if v > limit)
        parts: list[tuple[int, int | None, int]] = [(k, None, v) for k, v in n.items() if v <= limit]
        for at in range(0, len(self.heavy), 256):  # at most 256 symbols each
            some = self.heavy[at : at + 256]
            rows = tree.groupBy(g, t).agg(F.count(F.lit(1)).alias("n")).where(F.col("g").isin(some) & F.col("t").isNotNull()).toArrow()
            parts += list(zip(rows["g"].to_pylist(), rows["t"].to_pylist(), rows["n"].to_pylist()))
        self.pair = np.zeros(1 << 16, np.int64)
        self.third = np.zeros((len(self.heavy), 256), np.int64)
        self.pair[self.heavy] = -1 - np.arange(len(self.heavy))
        at, load = 0, 0
        for k, third, v in sorted(parts, key=lambda p: (p[0], -1 if p[1] is None else p[1])):
            if load and load + v > limit:
                at, load = at + 1, 0
            load += v
            if third is None:
                self.pair[k] = at
            else:
                self.third[-1 - self.pair[k], third] = at
        self.count = at + 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each packed window."""
        out = self.pair[(keys >> 8) & 0xFFFF]
        many = out < 0
        if many.any():
            out[many] = self.third[-1 - out[many], (keys[many] >> 24) & 0xFF]
        return out

    def tree(self, tree: DataFrame, b: int, depth: int) -> Tree:
        """A piece, collected, with the shorter contexts of all that it scores."""
        if self.count == 1:
            return _collected(tree, depth)
        spark = tree.sparkSession
        light = [(k, -1) for k in np.flatnonzero(self.pair == b).tolist()]
        split = [(g, t) for h, g in enumerate(self.heavy) for t in np.flatnonzero(self.third[h] == b).tolist()]
        split += [(g, -2) for g in {g for g, _ in split}]  # contexts of the two symbols alone
        mine = spark.createDataFrame(light + split, "g int, t int")
        g, t = _last_two(F.col("depth"), F.col("key")), _third(F.col("depth"), F.col("key"))
        named = tree.withColumn("g", g).withColumn("t", F.when(F.col("g").isin(self.heavy), F.coalesce(t, F.lit(-2))).otherwise(-1) if self.heavy else F.lit(-1))
        return _collected(named.join(F.broadcast(mine), ["g", "t"], "left_semi").drop("g", "t").unionByName(tree.where(g.isNull())), depth)


# --- scoring

def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 10, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_count: int = MIN_COUNT, min_next: int = MIN_NEXT, min_gain: float = MIN_GAIN, piece: int = PIECE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words (A-Z in lower case) and one end; null and blank texts have the end alone. Rows with held_out are
    scored but not learnt from; repeated rows are learnt from as often as they occur. ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) with the tokens' counts in training; ``score`` is the tree's log10 probability of the
    text. Without training rows base scores are 0 and every symbol has probability 1/256. No rows, no result. Other columns play no part.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    train = base.where(~F.col("held_out"))
    tree = checkpointed(grown(checkpointed(window_counts(train, depth)), depth, min_count, min_next, min_gain))
    words = checkpointed(word_counts(train))
    sums = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    texts = train.count()
    n, v = sums["n"] + texts, sums["v"] + (texts > 0)

    # At most 1 / FREQUENT words, whatever the corpus.
    often = words.where(F.col("c") >= F.lit(max(1.0, n * FREQUENT))).toArrow()
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(dict(zip(often["word"].to_pylist(), often["c"].to_pylist())))
    which = Pieces(tree, piece)

    def tree_scores(held, b: int, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each text's sum over the symbols whose contexts lie in piece ``b``."""
        if which.count == 1:
            coded = pa.array(keys).dictionary_encode()
            return np.add.reduceat(held.log10(np.asarray(coded.dictionary))[np.asarray(coded.indices)], starts)
        mine = np.flatnonzero(which.of(keys) == b)
        known, at = np.unique(keys[mine], return_inverse=True)
        each = np.zeros(len(keys))
        each[mine] = held.log10(known)[at]
        return np.add.reduceat(each, starts)

    first = sc.broadcast(which.tree(tree, 0, depth))

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "text", _SLICE):
                keys, starts, offsets, flat = windows(part.column("text"), depth)
                scores = tree_scores(first.value, 0, keys, starts)
                word = flat.dictionary_encode()
                c = np.fromiter((frequent.value.get(w, 0) for w in word.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(word.dictionary))[np.asarray(word.indices)] if len(flat) else np.zeros(0, np.int64)
                log = np.append(np.where(c > 0, np.log10(c + 0.1), 0.0), 0.0)
                count, rare = np.concatenate([[0], np.cumsum(c > 0)]), np.concatenate([[0], np.cumsum(c == 0)])
                a, b = offsets[:-1], offsets[1:]
                others = pa.ListArray.from_arrays(pa.array(rare[offsets], pa.int32()), flat.filter(pa.array(c == 0)).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("text_hash"), pa.array(b - a + 1), pa.array(count[b] - count[a]), pa.array(np.where(b > a, np.add.reduceat(log, a), 0.0)), pa.array(scores), others], names=["doc_id", "held_out", "text_hash", "n_tokens", "n_often", "often", "score", "rare"])

    kind = dict(base.dtypes)["doc_id"]
    hashed = base.withColumn("text_hash", F.xxhash64("text"))
    rows = hashed.select("doc_id", "held_out", "text_hash", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, text_hash long, n_tokens long, n_often long, often double, score double, rare array<binary>")
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    first.destroy()
    frequent.destroy()
    rest = rows.select("row", F.explode("rare").alias("w")).join(words.select(F.col("word").alias("w"), "c"), "w", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("seldom"), F.count("c").alias("n_seldom"))
    x = rows.join(rest, "row", "left")
    for b in range(1, which.count):
        held = sc.broadcast(which.tree(tree, b, depth))

        def more(batches, b=b, held=held):
            for batch in batches:
                for part in tokens.slices(batch, "text", _SLICE):
                    keys, starts, _, _ = windows(part.column("text"), depth)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(tree_scores(held.value, b, keys, starts))], names=["id", "th", "more"])

        # Rows alike in id and text have one score, so those two name it.
        added = checkpointed(hashed.select("doc_id", "text_hash", "text").mapInArrow(more, f"id {kind}, th long, more double").groupBy("id", "th").agg(F.max("more").alias("more")))
        held.destroy()
        x = x.join(added, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("th")), "left").withColumn("score", F.col("score") + F.col("more")).drop("id", "th", "more")
    total = F.log10(F.lit(n + 0.1 * (v + 1)))
    end = math.log10(texts + 0.1)
    known = F.col("n_often") + F.coalesce("n_seldom", F.lit(0)) + F.lit(int(texts > 0))
    return x.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("often") + F.coalesce("seldom", F.lit(0.0)) + end - F.col("n_tokens") * total).alias("base_score"), "score")
