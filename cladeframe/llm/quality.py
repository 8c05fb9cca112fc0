"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A naive Bayes classifier over binned shape features of the text and over hashed words and word pairs, learnt from labelled documents,
gives each document's evidence as a log likelihood ratio. Grouped sums of what the evidence says estimate how good hosts and
paths are; sparse paths are drawn towards their host, sparse hosts towards the global share, by as much as
the spread between groups, estimated from the same sums, asks for. A document's posterior joins its own evidence
with the prior of its path, its own part taken out of that prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm import tokens
from cladeframe.llm.common import checkpointed

#: At most so many labelled documents, those of the least md5 of their ids, are used to fit the classifier.
MAX_LABELLED = 50_000
#: A document is kept if its posterior probability of being good is at least this.
THRESHOLD = 0.5
#: Up to so many paths (about 100 bytes each) their priors are broadcast; beyond, they are joined.
BROADCAST_PATHS = 100_000
BINS, SMOOTHING, MOST_EVIDENCE = 16, 0.5, 30.0
#: Words and word pairs are hashed to so many buckets; one tells if its log likelihood ratio is so many standard errors from 0. Of a document's
#: telling buckets all count, each once, as their mean times WEIGHT: repeating itself makes no document better or worse.
BUCKETS, TELLING, WEIGHT = 1 << 18, 4.0, 2.0
FEATURES = ("upper_runs", "odd_symbols", "lone_symbols", "repeated_next", "repeated_pairs", "repeated_lines")

_KIND = np.zeros(256, np.uint8)  # by byte: 1 upper case, 2 a symbol that plain prose hardly has
_KIND[65:91] = 1
_KIND[list(b"!#$%&*<=>[]^_`{|}~\\")] = 2


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text: shares of bytes (upper case after upper case, odd symbols), of words (single odd
    symbols; equal to the one before), and of adjacent word pairs and lines that occurred before. None of them tells by
    length, so short texts aren't held against their authors. Null: all 0."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    data = pa.concat_arrays([texts]).cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    kinds, ends = _KIND[raw], ends - ends[0]
    size = np.maximum(1, np.diff(ends))
    upper = kinds == 1
    for k, hit in enumerate((upper & np.concatenate([[False], upper[:-1]]) if len(upper) else upper, kinds == 2)):
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        out[:, k] = (total[ends[1:]] - total[ends[:-1]]) / size
    flat, at = tokens.words(texts)
    if not len(flat):
        return out
    coded = flat.dictionary_encode()
    ids = np.asarray(coded.indices, dtype=np.int64)
    lengths = np.asarray(pc.binary_length(coded.dictionary), dtype=np.int64)[ids]
    first = np.array([ord(w[0]) if w[0] < "\x7f" else 65 for w in coded.dictionary.to_pylist()])
    lone = (lengths == 1) & (_KIND[first] == 2)[ids]
    same, pairs = np.concatenate([ids[1:] == ids[:-1], [False]]), np.concatenate([ids[:-1] * len(lengths) + ids[1:], [0]])
    for i, (text, a, b) in enumerate(zip(texts.to_pylist(), at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            lines = [x for x in text.split("\n") if x]
            out[i, 2:] = lone[a:b].mean(), same[a : b - 1].sum() / (b - a), 1 - len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b - a > 1 else 0, 1 - len(set(lines)) / max(1, len(lines))
    return out


def binned(x: np.ndarray) -> np.ndarray:
    """Shares as small integers on a square-root scale, so that small ones differ; 0 has a bin of its own."""
    return np.minimum(BINS - 1, np.ceil(np.sqrt(np.clip(x, 0, 1)) * (BINS - 1))).astype(np.int64)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and adjacent word pairs, and the text that each belongs to."""
    h, at = tokens.word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    inner = owner[1:] == owner[:-1]
    pairs = tokens.mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inner]
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][inner]]).astype(np.int64)


def buckets(texts: pa.Array, telling: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets (of those ``telling``, if given) of each text, one text after the other, and the text that each belongs to."""
    key, owner = _hashed(texts)
    if telling is not None:
        here = telling[key]
        key, owner = key[here], owner[here]
    both = np.unique(owner * BUCKETS + key)
    return both % BUCKETS, both // BUCKETS


@dataclass(frozen=True)
class Classifier:
    """Log likelihood ratios (good against bad) by feature and bin and by bucket of words, and the share of good documents among the labelled."""

    ratios: np.ndarray
    share: float
    words: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """The shape features' ratios, and WEIGHT times the mean of the telling buckets' (fewer than WEIGHT count as their sum)."""
        bins = binned(features(texts))
        shape = sum(self.ratios[k][bins[:, k]] for k in range(len(FEATURES)))
        if self.words.any():
            bucket, owner = buckets(texts, self.words != 0)
            ratio = self.words[bucket].astype(float)
            total = np.bincount(owner, ratio, len(texts))
            shape = shape + total * WEIGHT / np.maximum(WEIGHT, np.bincount(owner, minlength=len(texts)))
        return np.clip(shape, -MOST_EVIDENCE, MOST_EVIDENCE)


def word_ratios(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Log likelihood ratios of buckets, from how many documents of each kind have them; 0 for those that don't tell."""
    p, q = (good + SMOOTHING) / (n_good + 2 * SMOOTHING), (bad + SMOOTHING) / (n_bad + 2 * SMOOTHING)
    error = np.sqrt(np.maximum(0, 1 / (good + SMOOTHING) - 1 / (n_good + 2 * SMOOTHING)) + np.maximum(0, 1 / (bad + SMOOTHING) - 1 / (n_bad + 2 * SMOOTHING)))
    ratio = np.log(p / q)
    return np.where(np.abs(ratio) >= TELLING * np.maximum(error, 1e-9), ratio, 0.0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """The classifier of at most ``max_labelled`` labelled documents. Labels of 0.5 and more are good, several of one
    document are averaged; null ids and labels are left out. Without labelled documents of both kinds all ratios are 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).alias("__good"))
    chosen = known.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(max_labelled)
    # Proven bound: max_labelled rows of a long and a boolean.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id").select("text", "__good")

    def count(batches):
        total = np.zeros((2, len(FEATURES), BINS), np.int64)
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                bins, good = binned(features(part.column("text"))), np.asarray(part.column("__good").cast(pa.int8()))
                for k in range(len(FEATURES)):
                    np.add.at(total, (good, k, bins[:, k]), 1)
                bucket, owner = buckets(part.column("text"))
                np.add.at(seen, (good[owner], bucket), 1)
        for table, first in ((total.reshape(2, -1), 0), (seen, len(FEATURES) * BINS)):
            g, k = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (g, k + first, table[g, k])], names=["g", "k", "n"])

    # 2 * (FEATURES * BINS + BUCKETS) rows at most.
    sums = rows.mapInArrow(count, "g long, k long, n long").groupBy("g", "k").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros((2, len(FEATURES) * BINS + BUCKETS))
    every[np.asarray(sums["g"]), np.asarray(sums["k"])] = np.asarray(sums["n"])
    total, seen = every[:, : len(FEATURES) * BINS].reshape(2, len(FEATURES), BINS), every[:, len(FEATURES) * BINS :]
    of = total[:, 0].sum(axis=1)
    if of.min() == 0:
        return Classifier(np.zeros((len(FEATURES), BINS)), 1.0 if of.sum() == 0 else float(of[1] > 0), np.zeros(BUCKETS, np.float32))
    p = (total + SMOOTHING) / (of[:, None, None] + SMOOTHING * BINS)
    return Classifier(np.log(p[1] / p[0]), float((of[1] + 1) / (of.sum() + 2)), word_ratios(seen[0], seen[1], int(of[0]), int(of[1])))


def with_evidence(docs: DataFrame, model: Classifier, text_col: str = "text", out_col: str = "evidence", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the classifier's log likelihood ratio of each text; a narrow map. ``out_col`` is replaced."""
    schema = T.StructType([*(x for x in docs.schema.fields if x.name != out_col and (keep is None or x.name in keep)), T.StructField(out_col, T.DoubleType())])
    names = [x.name for x in schema.fields[:-1]]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(held.value.evidence(part.column(text_col)))], names=schema.names)

    return docs.select(*{*names, text_col}).mapInArrow(run, schema)


def _strength(groups: DataFrame, share: Column) -> Column:
    """How many documents' worth a group's prior is, by moments: share (1 - share) / spread between groups - 1, within 1 and 1e6.
    An aggregate over groups of n and s (sum of probabilities)."""
    n, s = F.col("n").cast("double"), F.col("s")
    total, g = F.sum(n), F.count(F.lit(1))
    var = share * (1 - share)
    spread = (F.sum(n * (s / n - share) * (s / n - share)) - (g - 1) * var) / (total - F.sum(n * n) / total)
    return F.when((g < 2) | spread.isNull() | (spread <= var * 1e-6), F.lit(1e6)).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), var / spread - 1)))


def path_priors(scored: DataFrame, share: float) -> DataFrame:
    """host, path, n, s, host_prior, path_strength of documents with ``p``: grouped sums, summed before each shuffle."""
    share_c = F.lit(float(np.clip(share, 1e-6, 1 - 1e-6)))
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = hosts.agg(_strength(hosts, share_c).alias("k")).first()["k"]
    k_path = paths.agg(_strength(paths, share_c).alias("k")).first()["k"]
    prior = hosts.select(F.col("host").alias("h"), ((F.col("s") + share_c * k_host) / (F.col("n") + k_host)).alias("host_prior"))
    return paths.join(prior, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "s", "host_prior", F.lit(float(k_path)).alias("path_strength"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those of ``keep``, all by default) with evidence, host_prior, path_prior, quality (posterior probability of being good) and
    kept (quality of ``threshold`` and more, so a tie with it is kept).

    A path is a value of ``path_col`` within one of ``host_col``; null hosts and paths are groups of their own. Null,
    empty and very short texts are judged as any other, very long ones as a whole. Without labels everything has quality 1 and is kept. Repeated rows stay and
    count as often. An empty table gives an empty table. Columns of the five names are replaced, all others are kept, whatever they are called.

    Where the text isn't kept, it is read once: the rest is checkpointed with the evidence, priors are summed from that and joined to it. Where it is kept,
    a checkpoint would be as large as the table, and evidence is worked out twice instead.
    """
    model = fit(docs, labels, max_labelled, id_col, text_col)
    share = float(np.clip(model.share, 1e-6, 1 - 1e-6))
    odds = float(np.log(share / (1 - share)))
    made = ("evidence", "host_prior", "path_prior", "quality", "kept")
    names = docs.columns
    own = {c: f"c{i}" for i, c in reversed(list(enumerate(names)))}  # by place, so that no name can clash
    stay = [f"c{i}" for i, c in enumerate(names) if c not in made and (keep is None or c in keep)]
    logistic = lambda x: 1 / (1 + F.exp(-x))
    rows = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumns({"host": F.col(own[host_col]), "path": F.col(own[path_col])})
    judged = lambda kept: with_evidence(rows, model, own[text_col], "evidence", [*kept, "host", "path"])
    thin = judged([]) if own[text_col] in stay else checkpointed(judged(stay))
    priors = path_priors(thin.select("host", "path", logistic(F.col("evidence") + odds).alias("p")), model.share)
    priors = checkpointed(priors.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_prior", F.col("path_strength").alias("k")))
    if priors.count() <= BROADCAST_PATHS:
        priors = F.broadcast(priors)
    x = (judged(stay) if own[text_col] in stay else thin).join(priors, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    mine = logistic(F.col("evidence") + odds)
    prior = (F.col("s") - mine + F.col("k") * F.col("host_prior")) / (F.col("n") - 1 + F.col("k"))
    x = x.withColumn("path_prior", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), prior)))
    x = x.withColumn("quality", logistic(F.col("evidence") + F.log(F.col("path_prior") / (1 - F.col("path_prior"))))).withColumn("kept", F.col("quality") >= threshold)
    back = {f"c{i}": c for i, c in enumerate(names)}
    return x.select(*(F.col(c).alias(back[c]) for c in stay), *made)
