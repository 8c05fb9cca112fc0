"""MinHash near-dedup: universal hash minima in bands, signature and full-set verification, components.

1. One pass over the texts gives every document a fingerprint of its shingle set, and the minima of 200
   universal hashes folded into 40 band keys of 5. Documents with equal sets become one class by a grouped
   aggregation, so copies cost nothing further.
2. Classes that share a band key are linked to the band's least class only (a star, not all pairs); links
   are tested by signature and confirmed on the full sets.
3. Components of these links. Bands whose members are all in one component are done. The members of the
   others get an exact way: of two sets with similarity t, the first n - ceil(t n) + 1 shingles in any common
   order share one, so members are clustered by their rarest shingles; each cluster is compared in pairs of bounded blocks, between
   different components only, by size, signature and full sets. A task returns no more links than it has members.
4. Components of all confirmed links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm import tokens
from cladeframe.llm.common import checkpointed
from cladeframe.llm.components import connected_components

#: Bands and rows: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^40 = 1e-7, one of 0.85 with 7e-11.
BANDS, ROWS, SEED = 40, 5, 7
SIGMAS = 6
#: A hub's links are verified in blocks of about so many.
SPOKES = 256


def hash_parameters(n: int = BANDS * ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and summands of the universal family h(x) = (a x + b) mod 2^64, ordered by its high bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles. Fewer words than ``width``: the whole sequence as one; none: empty."""
    h, offsets = tokens.word_hashes(texts)
    factors = tokens.mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    lengths = np.diff(offsets)
    k = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        k += h[j : len(h) - width + 1 + j] * factors[j] if len(k) else 0
    k = tokens.mixed(k)
    out = []
    for at, n in zip(offsets[:-1].tolist(), lengths.tolist()):
        if n >= width:
            out.append(np.unique(k[at : at + n - width + 1]))
        elif n:
            out.append(tokens.mixed((h[at : at + n] * factors[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The high 32 bits of every hash's minimum over the set."""
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 256):
        low = np.minimum(low, (a[:, None] * shingles[None, at : at + 256] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band: its minima and its number."""
    x = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        key = tokens.mixed(key * np.uint64(0x9E3779B97F4A7C15) + x[:, j])
    return key


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.BinaryType()), T.StructField("sig", T.BinaryType())])


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, fp (16 bytes that stand for the set), n, band keys, and the low byte of each minimum; empty sets have null in all but n."""
    a, b = hash_parameters(bands * rows)

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                out = []
                for s in shingle_sets(part.column("text"), width):
                    sig = signature(s, a, b) if len(s) else None
                    out.append((_fingerprint(s), len(s), band_keys(sig, bands, rows).tobytes(), sig.astype(np.uint8).tobytes()) if len(s) else (None, 0, None, None))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary())))], names=_SIGNED.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, _SIGNED)


def _links_by_text(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets, of words and not of hashes, are similar enough."""

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                if last[0] != a:
                    last = (a, _word_shingles(x, width))
                p, q = last[1], _word_shingles(y, width)
                common = len(p & q)
                if 100 * common >= percent * (len(p) + len(q) - common):
                    keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # A hub with many spokes is as many keys as it has blocks of them; its text goes to each block.
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int")).drop("blocks")
    hubs = texts.join(blocks, F.col("cid") == F.col("a")).select("a", F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    with_a = dealt.join(hubs, ["a", "block"])
    both = with_a.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def _word_shingles(text: str, width: int) -> set:
    w = text.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links, itself
    included), kept (doc_id = component_id), text_hash (xxhash64 of the text) and component (the group's number; null
    for rows in none).

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct ``width``-word shingles
    (A-Z in lower case; with fewer words, the whole sequence). A text that is null, empty or blank has no shingles
    and is linked with nothing: its component is its own id. So is a row with a null id, whose component is null
    and which is kept. Rows with one id but several texts share the id only: each is linked by its own text. Repeated
    rows are repeated in the result. An empty table gives an empty table; other columns play no part. Ids are whole numbers (or text of such);
    others raise an error.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows_signed = checkpointed(signed(base, width, bands, rows))
    classes = rows_signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = checkpointed(classes)
    # A class goes by its least id, so that a component's least class is the answer. Only where an id has several texts, and so stands for
    # several classes, are classes numbered instead, and components joined with their least ids.
    by_id = classes.groupBy("rep").count().where("count > 1").isEmpty()
    classes = classes.withColumn("cid", F.col("rep")) if by_id else checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))

    # Bands with two classes or more, and each one's least class.
    key = lambda i: F.substring(F.col("bands"), 8 * i + 1, 8)
    banded = classes.select("cid", F.explode(F.array(*(F.xxhash64(key(i)) for i in range(bands)))).alias("band"))
    hubs = banded.groupBy("band").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "hub")
    shared = checkpointed(banded.join(hubs, "band"), 200_000)

    # Texts of the classes in them, from one row each.
    member = shared.select("cid").distinct().join(classes.select("cid", "fp", "rep"), "cid")
    held = base.join(member.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = checkpointed(_texts_by_class(held, member, width), 4_000)

    stars = shared.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    links = checkpointed(_links_by_text(_by_signature(stars, classes, percent, bands * rows), texts, width, percent), 250_000)
    near = connected_components(links)

    # Bands that still hold several components: the exact way.
    labelled = shared.join(near.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    labelled = checkpointed(labelled.select("band", "cid", "component"), 200_000)
    open_bands = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    members = labelled.join(open_bands, "band", "left_semi").select("cid", "component").distinct()
    more = checkpointed(_linked_in_blocks(_clustered(texts, members, width, percent), classes, percent), 250_000)
    final = near if more.isEmpty() else connected_components(links.unionByName(more))

    named = classes.select("cid", "fp", "rep").join(final.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    if by_id:
        by_fp = named.select(F.col("fp").alias("class_fp"), F.col("component").alias("component_id"), "component")
    else:
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        by_fp = named.join(least, "component").select(F.col("fp").alias("class_fp"), "component_id", "component")
    out = rows_signed.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(by_fp, F.col("fp") == F.col("class_fp"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "component")


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest id, once.

    Rows with a null id or without shingles are in no group and all stay. Of several rows of that id in
    a group, as of repeated rows, one stays. Columns are unchanged.
    """
    found = near_duplicates(docs, percent, id_col=id_col, text_col=text_col)
    one = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__th"))
    alone = found.where("component IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).distinct()
    # Columns go by their places, so that a caller's may have any names.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    hashed = docs.toDF(*own.values()).withColumn("h", F.xxhash64(own[text_col]))
    on = lambda keys: (F.col(own[id_col]).cast("long") == keys["__id"]) & (F.col("h") == keys["__th"])
    chosen = hashed.join(one, on(one), "left_semi").dropDuplicates([own[id_col], "h"])
    every = chosen.unionByName(hashed.join(alone, on(alone), "left_semi")).unionByName(hashed.where(F.col(own[id_col]).isNull()))
    return every.select(*own.values()).toDF(*docs.columns)


def _texts_by_class(held: DataFrame, member: DataFrame, width: int) -> DataFrame:
    """cid and text, one row a class: an id may have several texts, so the fingerprint decides."""

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                fps = [_fingerprint(s) for s in shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.binary()), part.column("text")], names=["doc_id", "fp", "text"])

    found = held.mapInArrow(run, "doc_id long, fp binary, text string")
    m = member.select(F.col("rep").alias("r"), F.col("fp").alias("f"), "cid")
    return found.join(m, (F.col("doc_id") == F.col("r")) & (F.col("fp") == F.col("f"))).select("cid", "text").dropDuplicates(["cid"])


def _least_agreement(percent: int, n: int) -> int:
    """Of n minima, how many agree all but certainly: SIGMAS standard deviations below the expected number at the threshold."""
    t = percent / 100
    return int(np.floor(n * (t - SIGMAS * (t * (1 - t) / n) ** 0.5)))


def _by_signature(pairs: DataFrame, classes: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree in as many places as that makes near certain."""
    least = _least_agreement(percent, n)

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((p == q).sum(axis=1) >= least)

    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.where(agree("sa", "sb")).select("a", "b")


def _clustered(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """cid, component, cluster and the full set of shingles (packed, sorted) of the members that share one of their rarest
    shingles with one of another component; who shares one is in one cluster.

    Shingles are ordered by how many members have them, then by hash. Those that only one has come first, so they
    need not be joined, only counted.
    """

    def sets_of(batches):
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                packed = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("component"), pa.array(packed, pa.binary())], names=["cid", "component", "hashes"])

    def shingles_of(batches):
        for batch in batches:
            for part in tokens.slices(batch, "hashes"):
                sets = [np.frombuffer(x, np.int64) for x in part.column("hashes").to_pylist()]
                sizes = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(c)), sizes)) for c in ("cid", "component")] + [pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["cid", "component", "n", "h"])

    sets = checkpointed(texts.join(members, "cid").select("cid", "component", "text").mapInArrow(sets_of, "cid long, component long, hashes binary"), 4_000)
    each = sets.mapInArrow(shingles_of, "cid long, component long, n long, h long")
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1")
    shared = each.join(common, "h")
    ranked = shared.groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h", (F.col("lo") != F.col("hi")).alias("open")))).alias("hs"))
    prefix = F.ceil(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("hs")))
    rare = ranked.where(prefix > 0).select("cid", F.explode(F.slice("hs", F.lit(1), F.least(prefix, F.size("hs")).cast("int"))).alias("x"))
    rare = checkpointed(rare.where("x.open").select("cid", F.col("x.h").alias("h")), 250_000)
    hubs = rare.groupBy("h").agg(F.min("cid").alias("hub"))
    clusters = connected_components(rare.join(hubs, "h").where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct())
    return sets.join(clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "cid")


def _linked_in_blocks(clustered: DataFrame, classes: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) that join the components of each cluster as all links between its members would.

    A cluster's members are dealt to blocks of about ``block``; a task has two blocks (or one twice). What two members of
    components that the task has joined already could add is nothing, so they aren't compared.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sigs = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
        least = _least_agreement(percent, sigs.shape[1])
        sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        n, own, cid = np.array([len(s) for s in sets]), rows["own"].to_numpy(), rows["cid"].to_numpy()
        one_block = rows["i"].iloc[0] == rows["j"].iloc[0]
        codes, root = np.unique(rows["component"].to_numpy(), return_inverse=True)
        root = root.copy()
        out = []
        for x in range(len(rows)):
            if not one_block and own[x] != rows["i"].iloc[0]:
                continue
            other = np.arange(len(rows)) > x if one_block else own == rows["j"].iloc[0]
            at = np.flatnonzero(other & (root != root[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent))
            at = at[(sigs[at] == sigs[x]).sum(axis=1) >= least]
            for y in at:
                if root[y] != root[x]:
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (n[x] + n[y] - common):
                        out.append((cid[x], cid[y]))
                        root[root == root[y]] = root[x]
        return pd.DataFrame(out, columns=["a", "b"])

    clustered = checkpointed(clustered, 4_000)
    blocks = clustered.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    x = clustered.join(blocks, "cluster").join(classes.select("cid", "sig"), "cid").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "k")).withColumn("j", F.greatest("own", "k"))
    return x.select("cluster", "i", "j", "own", "cid", "component", "sig", "hashes").groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")
