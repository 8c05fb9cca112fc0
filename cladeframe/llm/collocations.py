"""Phrase collocations by vertical positional inverted lists.

Documents are read once, in blocks of bounded size; a block's lists give, for each of its words, the ascending positions where it
stands. A frequent phrase is extended by merging its positions with the lists of the words next to it: the list of the longer phrase is what
meets, and its length, summed over blocks, is the phrase's exact frequency. As every part of a frequent phrase is frequent, only
frequent phrases whose last words are frequent too are extended. Lists never leave their block: what is shuffled by word or
phrase is one count a block, so the commonest word or phrase of the corpus is as many rows as there are blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.llm import tokens
from cladeframe.llm.common import ensure_checkpoint_dir, released

#: A block has at most so many bytes of text, or one text.
BLOCK_BYTES = 8 << 20
#: Words and phrases are counted in shards by hash, one for about so many bytes of text.
SHARD_BYTES = 8 << 20
#: Phrases of a language are ranked in so many parts of so many parts first.
PARTS = 64
_KIND = np.zeros(256, np.uint8)  # by byte: 0 of a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
#: A block's lists, or its words of one language and shard, with their numbers in the block and their counts.
LISTS = "block long, shard long, lang string, words binary, counts binary, lists binary"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as byte planes, so that small ones take little room; what ascends goes by its steps."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        x = np.ascontiguousarray(c, dtype=np.int64)
        rising = bool(len(x)) and bool((x[1:] >= x[:-1]).all())
        x = np.diff(x, prepend=0) if rising else x
        parts += [bytes([rising]), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpacked(data: bytes, k: int) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(k):
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at + 1).reshape(8, -1).T).reshape(-1).view(np.int64)
        out.append(np.cumsum(x) if raw[at] else x)
        at += 1 + 8 * n
    return out


def _shards(keys: list[np.ndarray], shards: int) -> np.ndarray:
    """The shard of each row of keys."""
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = tokens.mixed(h * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64))
    return (h % np.uint64(shards)).astype(np.int64)


def positioned(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts (A-Z in lower case), the text that each is from, and their positions: adjacent words of a piece have adjacent
    positions, and between pieces or texts one position is left out."""
    data = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(data)
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[raw]
    word = kind == 0
    head = np.zeros(len(raw), bool)
    head[ends[:-1][ends[:-1] < len(raw)]] = True
    starts = np.flatnonzero(word & (head | np.concatenate([[True], ~word[:-1]])))
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.cumsum((kind == 2) | head, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)[starts]
    del kind, head
    positions = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(breaks[1:] > breaks[:-1])])
    kept = raw[word]
    kept += ((kept >= 65) & (kept <= 90)) * np.uint8(32)
    # A word's place among the words' bytes: how many of those come before it.
    lengths = np.add.reduceat(word, starts, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])
    return flat, np.searchsorted(ends, starts, "right") - 1, positions


def _block(block: int, texts: pa.Array, langs: pa.Array, shards: int) -> pa.RecordBatch | None:
    """A block's rows of LISTS."""
    flat, owner, positions = positioned(texts)
    if not len(flat):
        return None
    words = flat.dictionary_encode()
    lang = pc.fill_null(langs, "und").dictionary_encode()
    nl = len(lang.dictionary)
    key = np.asarray(words.indices, dtype=np.int64) * nl + np.asarray(lang.indices, dtype=np.int64)[owner]
    order = np.argsort(key, kind="stable")  # positions within a key stay in ascending order
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(key)]]))
    listed = positions[order]
    steps = np.concatenate([[0], np.diff(listed)])
    steps[first] = listed[first]
    of_word, of_lang = key[first] // nl, key[first] % nl
    said = words.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in said), np.uint64, len(said))
    shard = _shards([hashes[of_word], np.fromiter(map(xxhash.xxh3_64_intdigest, lang.dictionary.to_pylist()), np.uint64, nl)[of_lang]], shards)
    out: list[tuple] = [(block, -1, None, None, packed(sizes), packed(steps))]
    group = shard * nl + of_lang
    by = np.lexsort((np.argsort(np.argsort(np.array(said, object)))[of_word], group))
    cuts = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1], [True]]))
    names = lang.dictionary.to_pylist()
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows = by[i:j]  # a shard's words of a language, in order
        out.append((block, int(shard[rows[0]]), names[of_lang[rows[0]]], zstandard.compress(b"\n".join([said[k] for k in of_word[rows].tolist()]), 1), packed(rows, sizes[rows]), None))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["block", "shard", "lang", "words", "counts", "lists"])


def positional_lists(df: DataFrame, shards: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of LISTS: for each block of documents its packed lists (shard -1), and its words by shard and language."""

    def run(batches):
        ctx = TaskContext.get()
        block = (ctx.partitionId() if ctx else 0) << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flushed():
            nonlocal held, size, block
            out = _block(block, pa.concat_arrays([b.column(0).cast(pa.large_string()) for b in held]), pa.concat_arrays([b.column(1) for b in held]), shards)
            held, size, block = [], 0, block + 1
            return out

        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0), dtype=np.int64)
            at = 0
            for i, x in enumerate(lengths.tolist()):
                if size and size + x > BLOCK_BYTES:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    at = i
                    if (out := flushed()) is not None:
                        yield out
                        del out
                        pa.default_memory_pool().release_unused()
                size += x
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held and (out := flushed()) is not None:
            yield out

    return df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, LISTS)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back."""
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    released(df.sparkSession)
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _list_positions(counts: bytes, lists: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The word number of every listed position, and the positions."""
    (sizes,), (steps,) = unpacked(counts, 1), unpacked(lists, 1)
    total = np.cumsum(steps)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(np.arange(len(sizes)), sizes), total - np.repeat(total[first] - steps[first], sizes)


def _numbered(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of ``x`` in ``sorted_values``, which has them all."""
    return np.searchsorted(sorted_values, x)


def extended(listed: tuple[np.ndarray, np.ndarray], level: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of ``size`` words that a block's lists (word numbers and positions) hold: number of the phrase without its last word, number of that word, occurrences.

    ``level``, ``a``, ``b``, ``ids`` are the block's frequent words (level 1: ``a`` the word in the block, ``ids`` its number) and frequent phrases of fewer words
    than ``size`` (``a`` and ``b`` as in the result, ``ids`` the phrase's number).
    """
    own = level == 1
    word_ids, place = ids[own], np.full(int(a[own].max()) + 1 if own.any() else 0, -1, np.int64)
    by_id = np.argsort(word_ids)
    word_ids = word_ids[by_id]
    place[a[own][by_id]] = np.arange(len(word_ids))
    word, positions = listed
    here = word < len(place)
    word, positions = place[word[here]], positions[here]
    word, positions = word[word >= 0], positions[word >= 0]
    none = np.zeros(0, np.int64)
    if not len(word):
        return none, none, none
    at = np.full(int(positions.max()) + size + 1, -1, np.int64)  # the merged lists: which frequent word stands where
    at[positions] = word
    m, phrase, phrase_ids = len(word_ids), at, word_ids
    for k in range(2, size):
        rows = level == k
        by_id = np.argsort(ids[rows])
        next_ids, x, y = ids[rows][by_id], a[rows][by_id], b[rows][by_id]
        keys = _numbered(phrase_ids, x) * m + _numbered(word_ids, y)
        by_key = np.argsort(keys)
        found = np.flatnonzero((phrase[: 1 - k] >= 0) & (at[k - 1 :] >= 0))
        longer = np.full(len(at), -1, np.int64)
        if len(keys) and len(found):
            sought = phrase[found] * m + at[found + k - 1]
            hit = np.minimum(np.searchsorted(keys[by_key], sought), len(keys) - 1)
            longer[found] = np.where(keys[by_key][hit] == sought, by_key[hit], -1)
        phrase, phrase_ids = longer, next_ids
    found = np.flatnonzero((phrase[:-1] >= 0) & (phrase[1:] >= 0))
    found = found[found + size - 1 < len(at)]
    keys, n = np.unique(phrase[found] * m + at[found + size - 1], return_counts=True)
    return phrase_ids[keys // m], word_ids[keys % m], n


def _counted(least: int, level: int):
    """The step that sums a shard's counts over blocks: frequent words or phrases with new numbers (id, f and what they are made of), and for each block
    the packed ones that it has (a, b, id)."""

    def run(key, part):
        shard = key[0].as_py()
        names = ["block", "level", "known", "id", "f", "lang", "word", "a", "b"]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        blocks = np.asarray(part.column("block"), dtype=np.int64)
        if level == 1:
            langs = part.column("lang").combine_chunks().dictionary_encode()
            rows = [unpacked(x, 2) for x in part.column("counts").to_pylist()]
            size = np.array([len(r[0]) for r in rows])
            a, n = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
            words = pa.array([w for x in part.column("words").to_pylist() for w in zstandard.decompress(x).split(b"\n")], pa.large_binary()).dictionary_encode()
            b = np.zeros(len(a), np.int64)
            code = np.asarray(words.indices, dtype=np.int64) * len(langs.dictionary) + np.repeat(np.asarray(langs.indices, dtype=np.int64), size)
        else:
            rows = [unpacked(x, 3) for x in part.column("counts").to_pylist()]
            size = np.array([len(r[0]) for r in rows])
            a, b, n = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2))
            heads, x = np.unique(a, return_inverse=True)
            lasts, y = np.unique(b, return_inverse=True)
            code = x * len(lasts) + y
        kinds_of, own = np.unique(code, return_inverse=True)
        total = np.zeros(len(kinds_of), np.int64)
        np.add.at(total, own, n)
        often = total >= least
        number = np.where(often, np.cumsum(often) - 1, -1)
        ids, f = (shard << 32) + np.arange(int(often.sum())), total[often]
        kept, none = kinds_of[often], [None] * int(often.sum())
        if level == 1:
            said = words.dictionary.take(pa.array(kept // len(langs.dictionary))).cast(pa.binary()).cast(pa.string())
            new = [none, none, none, ids, f, langs.dictionary.take(pa.array(kept % len(langs.dictionary))), said, none, none]
        else:
            new = [none, none, none, ids, f, none, none, heads[kept // len(lasts)], lasts[kept % len(lasts)]]
        told = pa.table([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(new, kinds)], names=names)
        back, stop = [], np.cumsum(size)
        for block, j, k in zip(blocks.tolist(), stop.tolist(), size.tolist()):
            here = number[own[j - k : j]]
            if (here >= 0).any():
                at = np.flatnonzero(here >= 0) + j - k
                back.append((block, level, packed(a[at], b[at], (shard << 32) + number[own[at]]), *[None] * 6))
        return pa.concat_tables([told, pa.table([pa.array([r[i] for r in back], t) for i, t in enumerate(kinds)], names=names)])

    return run


_COUNTED = "block long, level int, known binary, id long, f long, lang string, word string, a long, b long"


def _extending(size: int, shards: int):
    """The step that takes a block's lists and its frequent words and phrases to its phrases of ``size`` words, packed by shard."""

    def run(key, left, right):
        out: list[tuple[int, bytes]] = []
        if left.num_rows and right.num_rows:
            parts = [(lv, *unpacked(x, 3)) for lv, x in zip(right.column("level").to_pylist(), right.column("known").to_pylist())]
            level = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
            known = [np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)]
            a, b, n = extended(_list_positions(left.column("counts")[0].as_py(), left.column("lists")[0].as_py()), level, *known, size)
            shard = _shards([a, b], shards)
            by = np.lexsort((b, a, shard))
            cuts = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1], [True]])) if len(by) else np.zeros(1, int)
            out = [(int(shard[by[i]]), packed(a[by[i:j]], b[by[i:j]], n[by[i:j]])) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int64()), "block": pa.array(np.full(len(out), key[0].as_py()), pa.int64()), "counts": pa.array([c for _, c in out], pa.binary())})

    return run


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/collocations-{uuid.uuid4()}"


def frequent_phrases(df: DataFrame, least: int, longest: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """n by lang, and for each number of words up to ``longest`` the phrases that occur ``least`` times or more in a language: id, f and,
    for words, lang and word, for longer ones a (id of the phrase without the last word) and b (id of that word)."""
    spark = df.sparkSession
    folder = _folder(spark)
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    lists = _stored(positional_lists(df, shards, text_col, lang_col), folder, "lists")
    total = lists.where("shard >= 0").select("lang", "counts").mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    blocks = lists.where("shard = -1").select("block", "counts", "lists")
    counts, known, levels = lists.where("shard >= 0").select("shard", "block", "lang", "words", "counts"), None, []
    for k in range(1, longest + 1):
        if k > 1:
            counts = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_extending(k, shards), "shard long, block long, counts binary")
        made = _stored(counts.groupBy("shard").applyInArrow(_counted(least, k), _COUNTED), folder, f"level{k}")
        levels.append(made.where("id IS NOT NULL").select("id", "f", *(("lang", "word") if k == 1 else ("a", "b"))))
        here = made.where("block IS NOT NULL").select("block", "level", "known")
        known = here if known is None else known.unionByName(here)
    return total, levels


def _totals(batches):
    """How many words each row of a language stands for."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([int(unpacked(x, 2)[1].sum()) for x in batch.column("counts").to_pylist()], pa.int64())], names=["lang", "n"])


def collocations(df: DataFrame, least: int = 10, longest: int = 3, inside_percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, then a, both descending, then phrase.

    Words are runs of anything but space and tab within pieces, which end at ``.,;:!?`` and line breaks; A-Z counts as lower case. Phrases have 2 to ``longest``
    words and occur a >= ``least`` times. Of the cuts into a first part (l occurrences) and a rest (r) the one of the least floor(1000000 a a / (l r)) counts, of
    equal ones that with the shortest first part. A phrase inside a longer one that has at least ``inside_percent`` of its occurrences is left out. Null and
    empty texts have no words, a null language is ``und``; repeated rows count each time; very long texts are a block of their own; an empty table gives an
    empty one. Other columns, of any names, aren't read.

    The tables of lists and of counts stay as Parquet in the shared checkpoint folder, together about as large as the texts.
    """
    total, levels = frequent_phrases(df, least, longest, text_col, lang_col)
    folder = _folder(df.sparkSession)
    words = levels[0]
    # Of the phrases of a level: text, language, rest (the phrase without its first word); cuts: occurrences of first parts and rests by cut.
    whole = words.select("id", "f", "lang", F.col("word").alias("phrase"), F.lit(None).cast("long").alias("rest"))
    out: DataFrame | None = None
    cuts: DataFrame = words.select("id", F.array().cast("array<long>").alias("l"), F.array().cast("array<long>").alias("r"))
    for size in range(2, longest + 1):
        # The rest of a phrase (all but its first word) is a phrase of one word fewer: the rest of its first part, and its last word.
        this = levels[size - 1]
        p = whole.select(F.col("id").alias("a"), F.col("lang"), F.col("phrase").alias("head"), F.col("f").alias("fa"), F.col("rest").alias("head_rest"))
        w = words.select(F.col("id").alias("b"), "word", F.col("f").alias("fb"))
        x = this.join(p, "a").join(w, "b")
        if size == 2:
            x = x.withColumn("rest", F.col("b"))
        else:
            before = levels[size - 2].select(F.col("id").alias("rest"), F.col("a").alias("head_rest"), "b")
            x = x.join(before, ["head_rest", "b"])
        heads, rests = cuts.select(F.col("id").alias("a"), F.col("l").alias("la")), cuts.select(F.col("id").alias("rest"), F.col("r").alias("rr"))
        rest_f = whole.select(F.col("id").alias("rest"), F.col("f").alias("fr"))
        x = x.join(heads, "a").join(rests, "rest").join(rest_f, "rest")
        # First parts of 1 .. size - 1 words: those of the first part's own cuts, then it; rests: the rest, then its own cuts' rests.
        x = x.withColumn("l", F.concat("la", F.array("fa"))).withColumn("r", F.concat(F.array("fr"), "rr"))
        x = _stored(x.select("id", "f", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "a", "rest", "l", "r"), folder, f"phrases{size}")
        if size > 2:
            held = x.select(F.explode(F.array("a", "rest")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            free = told.join(held, "id", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * inside_percent)).drop("longer")
            out = free if out is None else out.unionByName(free)
        told = x
        whole, cuts = x.select("id", "f", "lang", "phrase", "rest"), x.select("id", "l", "r")
    out = told if out is None else out.unionByName(told)
    # Exact for up to 10^15 occurrences: 10^6 a a has at most 36 digits; the quotient is at most 10^6.
    of = lambda c: F.col(c).cast("decimal(15,0)")
    scored = out.select("id", "lang", "phrase", F.col("f").alias("a"), F.posexplode(F.arrays_zip("l", "r")).alias("k", "cut")).select("lang", "phrase", "a", "k", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))
    scored = scored.withColumn("num", (F.lit(1_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)")) * F.col("a").cast("decimal(15,0)")).withColumn("den", of("l") * of("r"))
    scored = scored.withColumn("score", F.expr("num div den"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part of a language, of each of a few parts of parts, and of all: no task ranks more than a part's, or some tops.
    led = best.withColumn("p", F.pmod(F.xxhash64("phrase"), F.lit(PARTS * PARTS)).cast("int"))
    for _ in range(2):
        led = led.withColumn("rank", F.row_number().over(W.partitionBy("lang", "p").orderBy(*order))).where(F.col("rank") <= top).drop("rank").withColumn("p", F.floor(F.col("p") / PARTS).cast("int"))
    ranked = led.drop("p").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, d, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, p, unnest(w) AS w, unnest(range(len(w))) AS i FROM q),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
g AS (SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM o WINDOW x AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
held AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, w1 AS a, w2 AS b, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
    LEFT JOIN held h ON h.lang = f2.lang AND h.a = f2.w1 AND h.b = f2.w2 WHERE f2.f >= 10 AND (h.f IS NULL OR 100 * h.f < 50 * f2.f)
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n ON n.lang = b.lang
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
