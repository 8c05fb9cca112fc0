"""From raw documents to token ids: quality classifier, near-duplicates, mixing by source, byte-level BPE.

Each stage is one operator of ``cladeframe.llm`` over all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import bpe, minhash, mixing, quality
from cladeframe.llm.common import ensure_checkpoint_dir, table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named by their places, so that no operator's own columns can clash with them, and those names by column."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject, unchanged; repeated rows stay.

    Null, empty and very short texts are judged as any other, very long ones as a whole; null sources and languages are groups of their own. Without
    labels, all documents stay; an empty table gives an empty table.
    """
    plain, own = _by_place(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", own["doc_id"])
    judged = quality.classify(plain, labels, id_col=own["doc_id"], text_col=own["text"], host_col=own["source"], path_col=own["lang"])
    return judged.where("kept").select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the smallest id, once.

    Documents with a null id, or without words, are in no group and stay.
    """
    return minhash.deduplicated(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target weight takes it, whole.

    Documents without words (null, empty or blank texts) add nothing to a mix of words and aren't in it. A null source is a source of its own; very
    long documents count as a whole, and one that holds its source's cut is taken if half of it lies before. Repeated rows are taken one by one.
    """
    plain, own = _by_place(docs)
    mixed = mixing.mix(plain, cut="documents", id_col=own["doc_id"], text_col=own["text"], source_col=own["source"])
    return mixing.repeated(mixed).toDF(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the packed ids of every row, and whether decoding gives the text's bytes back. A null text counts as empty: no ids. Very
    long texts are encoded in pieces that give the whole's ids. Repeated rows are repeated; other columns end here."""
    both = bpe.round_tripped(docs.select("doc_id", "source", "text"), RANK_FILE, public_tokenizers.PATTERN)
    return both.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Neither the classifier nor the tokenizer can be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them Parquet in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
