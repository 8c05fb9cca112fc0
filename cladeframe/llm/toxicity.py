"""Toxicity by multiple-instance learning: documents are bags of sentences, and only bags have labels.

A sentence is toxic with a probability given by the words it has and what they begin with; a document is toxic if any of its sentences is, or for no
reason that its words tell (the leak, which takes up labels that nothing explains): a noisy-or. Training raises the likelihood of documents'
labels, so a sentence of a toxic document is pressed to be toxic only as far as no other sentence explains the label. That is why
the sentence probabilities can then locate what offends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import checkpointed

#: At most so many labelled documents, those of the least md5 of their ids, are learnt from.
MAX_LABELLED = 20_000
#: At most so many word beginnings have weights.
MAX_FEATURES = 8192
#: Beginnings of these lengths count, besides the whole word.
BEGINNINGS = range(3, 9)
#: A beginning is taken if it stands in so many toxic documents, in a share of them so many times that of the others, and by a likelihood ratio
#: beyond what the best of so many tried would reach by chance.
LEAST_TOXIC, LEAST_LIFT = 3, 3.0
ROUNDS, STEP, SHRINK = 60, 0.25, 0.25
OFFENDING = 0.5
_SENTENCE = re.compile(r"[^.!?\n\r…。！？]+")
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 1 << 17


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start and end (in code points) and the words, in lower case, of each stretch between sentence ends or line breaks."""
    for m in _SENTENCE.finditer(text):
        yield m.start(), m.end(), _WORD.findall(m.group().lower())


def beginnings(word: str) -> list[str]:
    """What a word is told by: its first letters, and itself, marked by a blank."""
    return [*(word[:k] for k in BEGINNINGS if k <= len(word)), word + " "]


@dataclass(frozen=True)
class Model:
    """Weights by beginning, the sentences' common weight, and the log odds of the leak (None where there was nothing to learn from)."""

    weights: dict[str, float]
    bias: float
    leak: float | None


class Reader:
    """Which known beginnings each sentence of a text has."""

    def __init__(self, known: dict[str, int]):
        self.known, self.cache = known, {}
        self.heads = {k[:3] for k in known if len(k) > 2} | {k for k in known if len(k) <= 3}

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= _CACHED:
                self.cache.clear()
            got = tuple(self.known[b] for b in beginnings(word) if b in self.known) if word[:3] in self.heads or word + " " in self.heads else ()
            self.cache[word] = got
        return got

    def told(self, text: str | None) -> list[tuple[int, int, tuple[int, ...]]]:
        """Start, end and the distinct features of each sentence that has any."""
        out = []
        for start, stop, words in sentences(text or ""):
            found = {f for w in words for f in self.of_word(w)}
            if found:
                out.append((start, stop, tuple(sorted(found))))
        return out


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """toxic and text of the sampled labelled documents whose crc32(id as text) mod 5 isn't 0. Several labels of an id count as the highest; null ones don't."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(id AS string)) % 5 != 0")
    chosen = own.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(MAX_LABELLED)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("toxic", "text")


def selected(rows: DataFrame) -> dict[str, int]:
    """The telling beginnings, the strongest first, numbered."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        total = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                total[toxic] += 1
                words = {w for _, _, ws in sentences(text or "") for w in ws}
                for b in {b for w in words for b in beginnings(w)}:
                    counts.setdefault(b, [0, 0])[toxic] += 1
                if len(counts) > 1 << 19:  # (sums go out early, so a task's memory is bounded)
                    yield _counts(counts)
                    counts = {}
        counts[""] = total
        yield _counts(counts)

    n = rows.mapInArrow(run, "b string, clean long, toxic long").groupBy("b").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = checkpointed(n)
    total = n.where("b = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    tried = max(2, n.where(f"toxic + clean >= {LEAST_TOXIC}").count())
    c, t, nc, nt = F.col("clean").cast("double"), F.col("toxic").cast("double"), float(total["clean"]), float(total["toxic"])
    share = (c + t) / (nc + nt)
    part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    ratio = 2 * (part(t, nt * share) + part(c, nc * share) + part(nt - t, nt * (1 - share)) + part(nc - c, nc * (1 - share)))
    lifted = (t + 0.5) / (nt + 1) >= LEAST_LIFT * (c + 0.5) / (nc + 1)
    best = n.where("b != ''").where(lifted & (t >= LEAST_TOXIC)).select("b", F.round(ratio, 6).alias("g")).where(F.col("g") >= 2 * math.log(tried)).orderBy(F.desc("g"), "b").limit(MAX_FEATURES)
    return {r["b"]: k for k, r in enumerate(best.collect())}


def _counts(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], names=["b", "clean", "toxic"])


def bags(rows: DataFrame, known: dict[str, int]) -> DataFrame:
    """toxic, features (packed numbers, sentence by sentence) and sizes (packed) of each document. Of sentences alike in features, one counts."""

    def run(batches):
        reader = Reader(known)
        for batch in batches:
            found = [sorted({f for _, _, f in reader.told(t)}) for t in batch.column("text").to_pylist()]
            packed = [np.array([x for s in d for x in s], "<i4").tobytes() for d in found]
            sizes = [np.array([len(s) for s in d], "<i4").tobytes() for d in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())], names=["toxic", "features", "sizes"])

    return rows.mapInArrow(run, "toxic int, features binary, sizes binary")


def gradient(toxic: np.ndarray, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, weights: np.ndarray, bias: float, leak: float) -> np.ndarray:
    """Log likelihood of documents' labels and its slope by the weights, the bias and the leak's log odds, one after the other.

    ``features`` sentence by sentence, ``sizes`` of the sentences, ``counts`` of each document's sentences.
    """
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    no = lambda z: -np.logaddexp(0, z)  # noqa: E731  (log of one minus the logistic)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    z = bias + np.bincount(sentence, weights[features], len(sizes))
    doc = np.repeat(np.arange(len(counts)), counts)
    log_none = np.bincount(doc, no(z), len(counts)) + no(leak)
    none = np.exp(log_none)
    some = np.maximum(-np.expm1(log_none), 1e-300)
    pull = np.where(toxic == 1, none / some, -1.0)  # a sentence's slope is its probability times this
    slope = logistic(z) * pull[doc]
    return np.concatenate([[np.where(toxic == 1, np.log(some), log_none).sum()], np.bincount(features, slope[sentence], len(weights)), [slope.sum(), logistic(leak) * pull.sum()]])


def fit(rows: DataFrame, known: dict[str, int], rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The weights after ``rounds`` steps (Adam's, on all bags) up the penalised likelihood, and the likelihood before each. A round is one pass over the
    packed bags; each task sends one vector."""
    held = checkpointed(bags(rows, known))
    held = held.coalesce(min(16, max(1, held.rdd.getNumPartitions())))
    n = len(known)
    at = np.concatenate([np.full(n, 1.0), [-2.0, -3.0]])
    mean, square, seen = np.zeros(n + 2), np.zeros(n + 2), []
    for k in range(1, rounds + 1):

        def run(batches, at=at):
            total = np.zeros(n + 3)
            for b in batches:
                f = np.frombuffer(b"".join(b.column("features").to_pylist()), "<i4")
                s = np.frombuffer(b"".join(b.column("sizes").to_pylist()), "<i4")
                counts = np.array([len(x) // 4 for x in b.column("sizes").to_pylist()], np.int64)
                total += gradient(np.asarray(b.column("toxic")), f, s, counts, at[:n], float(at[n]), float(at[n + 1]))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

        total = sum(np.frombuffer(bytes(r["g"])) for r in held.mapInArrow(run, "g binary").collect())
        seen.append(float(total[0]) - SHRINK / 2 * float((at[:n] ** 2).sum()))
        slope = total[1:] - np.concatenate([SHRINK * at[:n], [0.0, 0.0]])
        mean, square = 0.9 * mean + 0.1 * slope, 0.98 * square + 0.02 * slope**2
        at = at + STEP * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.98**k)) + 1e-9)
    return Model({b: float(at[i]) for b, i in known.items()}, float(at[n]), float(at[n + 1])), seen


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled documents that aren't held out."""
    rows = checkpointed(training_rows(docs, labels, id_col, text_col, label_col))
    known = selected(rows)
    if not known:
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
        return Model({}, 0.0, math.log((n["t"] + 0.5) / (n["n"] - n["t"] + 0.5)) if n["n"] else None)
    return fit(rows, known)[0]


def judged(text: str | None, reader: Reader, weights: list[float], bias: float, leak: float | None) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's probability and the start, end and probability of each offending sentence."""
    log_none, places, seen = (-math.log1p(math.exp(leak)) if leak is not None else 0.0), [], {}
    for start, stop, found in reader.told(text):
        p = seen.get(found)
        if p is None:
            z = bias + sum(weights[f] for f in found)
            p = seen[found] = 1 / (1 + math.exp(-z)) if z > -500 else 0.0
            log_none += -math.log1p(math.exp(z)) if z < 30 else -z
        if p >= OFFENDING:
            places.append((start, stop, p))
    return -math.expm1(log_none), places


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (the probability that the document is toxic) and ``offending``: start, stop (code points) and probability of the sentences that are more likely
    toxic than not.

    A narrow map over whole texts. Null and empty texts, and those of which no word tells anything, score the leak alone (0 if there was nothing to learn from).
    Repeated rows are scored each; repeated sentences are located each but count once. Memory grows with the longest text. Other columns aren't read.
    """
    known = {b: i for i, b in enumerate(model.weights)}
    weights = list(model.weights.values())

    def run(batches):
        reader = Reader(known)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            made = [judged(t.as_py(), reader, weights, model.bias, model.leak) for t in batch.column("text")]
            places = [[{"start": a, "stop": b, "probability": p} for a, b, p in found] for _, found in made]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s for s, _ in made], pa.float64()), pa.array(places, kind)], names=["id", "score", "offending"])

    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, score double, offending array<struct<start: int, stop: int, probability: double>>")
    return out.select(F.col("id").alias(id_col), "score", "offending")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """:func:`score` by a model of the labels that aren't held out, with held_out (crc32 of the id as text mod 5 is 0; null for a null id) and predicted (score of 0.5 or more).

    An empty table gives an empty one; without labels every score is 0.
    """
    out = score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.withColumn("held_out", F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
