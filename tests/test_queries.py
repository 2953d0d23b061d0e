"""Every registered query against its DuckDB form, the contract, and life without the llm subpackage."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from caselight.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_duckdb(spark, con, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(oracles.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name,column", [("final_decisions", "decision_found"), ("section_split", "facts_inferred")])
def test_enriched_queries_are_not_vacuous(spark, name, column):
    got = queries.queries()[name](spark, DATA).toPandas()[column]
    assert 0 < got.sum() < len(got)


@pytest.mark.parametrize("name", ["fact_evidence", "issue_evidence", "legal_basis_evidence", "reasoning_evidence"])
def test_evidence_hits_some_rows(spark, name):
    n = queries.queries()[name](spark, DATA).toPandas()["n"]
    assert 0 < (n > 0).sum() < len(n)


def test_queries_without_sql_stay_in_range(spark):
    for name, column, top in (("rouge_l", "rougeL_f", 1), ("bleu", "bleu", 100)):
        v = queries.queries()[name](spark, DATA).toPandas()[column]
        assert len(v) and v.between(0, top).all() and v.nunique() > 5


def test_entry_without_the_llm_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "caselight"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "caselight/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'pipeline' not in q; print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0 and int(run.stdout) == len(queries.queries()), run.stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "caselight").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("fulfilment", ""), p
