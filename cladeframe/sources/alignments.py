"""Sequence and table files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladeframe.functions.sequences import NULL_TOKENS


def read_fasta(spark: SparkSession, path: str, alphabet: str | None = None, gap: str = "-") -> DataFrame:
    """aln_id (file), seq_idx, name, info and seq (array; null: gap) of FASTA files: one row a record.

    Files are split at record starts by Spark's text reader, so large ones are read in parallel; ``seq_idx`` is a record's place among
    its file's by byte order of reading. With an alphabet, records that hold another symbol fail.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("aln_id"), F.monotonically_increasing_id().alias("__at"), F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\n\r]*)", 1)
    body = F.regexp_replace(F.substring("r", F.length(head) + 1, F.length("r")), r"\s", "")
    rows = raw.select("aln_id", "__at", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("info"), body.alias("body"))
    if alphabet is not None:
        bad = F.translate("body", alphabet + alphabet.lower() + gap, "")
        rows = rows.withColumn("body", F.when(bad == "", F.col("body")).otherwise(F.raise_error(F.concat(F.lit("symbols outside the alphabet in "), F.col("name")))))
    rows = rows.withColumn("seq_idx", F.row_number().over(W.partitionBy("aln_id").orderBy("__at")) - 1)
    symbols = F.filter(F.split("body", ""), lambda s: s != "")
    return rows.select("aln_id", "seq_idx", "name", "info", F.transform(symbols, lambda s: F.when(s != gap, s)).alias("seq"))


def read_clustal(spark: SparkSession, path: str, gap: str = "-") -> DataFrame:
    """The same for Clustal files: blocks are put together by name. A file that doesn't begin with CLUSTAL fails."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("aln_id"), F.col("value"))
    text = text.withColumn("value", F.when(F.ltrim("value").startswith("CLUSTAL"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a Clustal file: "), F.col("aln_id")))))
    lines = text.select("aln_id", F.posexplode(F.split("value", "\r?\n")).alias("line", "l")).where(F.col("line") > 0)
    parts = lines.withColumn("m", F.split(F.rtrim("l"), r"\s+")).where((F.size("m") >= 2) & F.col("l").rlike(r"^\S"))
    seqs = parts.groupBy("aln_id", F.col("m")[0].alias("name")).agg(F.min("line").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", F.col("m")[1].alias("s")))), lambda x: x["s"]), "").alias("body"))
    seqs = seqs.withColumn("seq_idx", F.row_number().over(W.partitionBy("aln_id").orderBy("first")) - 1)
    return seqs.select("aln_id", "seq_idx", "name", F.lit("").alias("info"), F.transform(F.filter(F.split("body", ""), lambda s: s != ""), lambda s: F.when(s != gap, s)).alias("seq"))


def sniff(spark: SparkSession, path: str) -> str:
    """FASTA, CLUSTAL, STOCKHOLM, NEXUS or NEWICK by a file's first line that isn't blank."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    line = first["value"].lstrip() if first else ""
    for start, name in ((">", "FASTA"), ("CLUSTAL", "CLUSTAL"), ("# STOCKHOLM", "STOCKHOLM"), ("#NEXUS", "NEXUS"), ("(", "NEWICK")):
        if line.startswith(start):
            return name
    raise ValueError(f"unknown format: {path}")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA or Clustal alignment; sequences of unequal length fail."""
    readers = {"FASTA": read_fasta, "CLUSTAL": read_clustal}
    kind = sniff(spark, path)
    if kind not in readers:
        raise ValueError(f"{kind} files are not supported")
    seqs = readers[kind](spark, path)
    width = F.size("seq")
    w = W.partitionBy("aln_id")
    ragged = F.min(width).over(w) != F.max(width).over(w)
    return seqs.withColumn("seq", F.when(~ragged, F.col("seq")).otherwise(F.raise_error(F.lit("sequences of unequal length"))))


def long_form(seqs: DataFrame) -> DataFrame:
    """aln_id, leaf, pos, sym: a row for each cell; null symbols are gaps."""
    return seqs.select("aln_id", F.col("name").alias("leaf"), F.posexplode("seq").alias("pos", "sym")).withColumn("pos", F.col("pos").cast("long"))


def stripped(seq):
    return F.filter(seq, lambda s: s.isNotNull())


def fasta_text(seqs: DataFrame, gap: str = "-") -> DataFrame:
    """value: records as text, for a text sink."""
    return seqs.select(F.concat(F.lit(">"), "name", F.when(F.coalesce("info", F.lit("")) != "", F.concat(F.lit(" "), "info")).otherwise(""), F.lit("\n"), F.array_join("seq", "", gap)).alias("value"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    fasta_text(seqs).write.text(path)


def clustal_text(seqs: DataFrame, block: int = 60, gap: str = "-") -> DataFrame:
    """block, seq_idx, value: lines of padded blocks; sort by block and seq_idx below a CLUSTAL line."""
    joined = seqs.withColumn("__s", F.array_join("seq", "", gap))
    n = F.ceil(F.length("__s") / block).cast("int")
    x = joined.withColumn("block", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return x.select("block", "seq_idx", F.concat(F.rpad("name", 20, " "), F.lit(" "), F.substring("__s", (F.col("block") * block + 1).cast("int"), F.lit(block))).alias("value"))


def read_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A tab-separated file as strings; lines that begin with # are left out, blank cells and words for nothing are null."""
    df = spark.read.csv(path, sep="\t", comment="#", header=header, mode="PERMISSIVE")
    return df.select(*(F.when((F.trim(F.col(f"`{c}`")) == "") | F.col(f"`{c}`").isin(*NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns))


def write_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """graph (file), from_pos, to_pos of JSON documents with Edgeindices."""
    docs = spark.read.option("multiLine", True).json(path)
    return docs.select(F.input_file_name().alias("graph"), F.explode("Edgeindices").alias("e")).select("graph", F.col("e")[0].alias("from_pos"), F.col("e")[1].alias("to_pos"))
