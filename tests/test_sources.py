import json

import pytest

from cladeframe.sources import alignments as A
from cladeframe.streaming import jobs


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a first one\nAC-G\nT\n>b\nACGGT\n")
    s = A.read_alignment(spark, str(tmp_path / "x.fa")).orderBy("seq_idx").collect()
    assert [(r.name, r.info, r.seq) for r in s] == [("a", "first one", ["A", "C", None, "G", "T"]), ("b", "", list("ACGGT"))]
    A.write_fasta(A.read_fasta(spark, str(tmp_path / "x.fa")), str(tmp_path / "out"))
    again = A.read_fasta(spark, str(tmp_path / "out")).collect()
    assert {(r.name, tuple(r.seq)) for r in again} == {(r.name, tuple(r.seq)) for r in s}


def test_bad_files_fail(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a\nAC\n>b\nACG\n")
    with pytest.raises(Exception, match="unequal"):
        A.read_alignment(spark, str(tmp_path / "r.fa")).collect()
    with pytest.raises(Exception, match="alphabet"):
        A.read_fasta(spark, str(tmp_path / "r.fa"), alphabet="A").collect()
    (tmp_path / "n.txt").write_text("#NEXUS\n")
    with pytest.raises(ValueError):
        A.read_alignment(spark, str(tmp_path / "n.txt"))


def test_clustal(spark, tmp_path):
    (tmp_path / "x.aln").write_text("CLUSTAL W\n\na  AC-\nb  ACG\n   ** \n\na  TT\nb  T-\n")
    s = A.read_alignment(spark, str(tmp_path / "x.aln")).orderBy("seq_idx").collect()
    assert [(r.name, r.seq) for r in s] == [("a", ["A", "C", None, "T", "T"]), ("b", ["A", "C", "G", "T", None])]
    assert [r.value.split()[1] for r in A.clustal_text(A.read_alignment(spark, str(tmp_path / "x.aln")), 3).orderBy("block", "seq_idx").collect()] == ["AC-", "ACG", "TT", "T-"]


def test_table_with_words_for_nothing(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# a comment\nname\tx\na\t1\nb\tNone\nc\t\n")
    assert [(r.name, r.x) for r in A.read_table(spark, str(tmp_path / "t.tsv")).orderBy("name").collect()] == [("a", "1"), ("b", None), ("c", None)]


def test_job_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"job": j, "command": c, "auth": "", "params": p}) for j, c, p in (("1", "len", "abc"), ("2", "nope", ""))))
    commands = {"len": lambda d: d.selectExpr("job", "cast(length(params) as string) AS result")}
    jobs.serve(jobs.requests(spark, str(tmp_path / "in")), commands, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = {(r.job, r.status, r.result) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {("1", "COMPLETED", "3"), ("2", "FAILED", None)}


def test_event_windows(spark):
    e = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    assert [(r.n, r.total) for r in jobs.event_counts(e).collect()] == [(2, 3.0)]
