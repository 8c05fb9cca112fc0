"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cladeframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def text(v):
        return "NULL" if v is None or pd.isna(v) else f"{float(v):.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("gone", [["cladeframe/llm", "tests/llm"], ["cladeframe/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_needs_no_training_data_package(tmp_path, gone):
    """A copy of the repository without those folders, with and without the pipeline, still has all other queries."""
    root = Path(__file__).resolve().parents[1]
    skip = {str(root / g) for g in gone}
    copy = shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or f"{d}/{n}" in skip])
    assert not any((copy / g).exists() for g in gone)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(re.match('op[0-9]+_', n) for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": os.pathsep.join(x for x in os.environ["PYTHONPATH"].split(os.pathsep) if Path(x).resolve() != root)} if "PYTHONPATH" in os.environ else {}))
