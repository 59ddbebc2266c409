"""The driver's contract: the flagship query has rows, every query and its SQL agree in columns."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = ["events", "orders", "customer", "conversations", "documents", "labels", "embeddings", "lineitem", "part", "supplier",
          "nation", "region", "pages", "benchmark"]


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.filter("fused IS NOT NULL").count() > 0


def test_sql_keys_and_columns():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 120
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, text in sql.items():
        assert con.sql(text).columns, name


def test_every_beat_is_in_a_phase_at_every_size(spark):
    from pulsegrid.catalog import all_queries

    run = all_queries()["session_points_in_phases"].run
    for folder in (SF, SF.replace("0.001", "0.1")):
        beats = spark.read.parquet(f"{folder}/events.parquet").count()
        assert run(spark, folder).groupBy().sum("n").first()[0] == beats


@pytest.mark.parametrize("gone", [["pulsegrid/llm", "tests/llm"], ["pulsegrid/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_text_operators_can_be_taken_away(tmp_path, gone):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "repo").mkdir()
    left_out = [str(root / g) for g in gone]
    for p in ("pulsegrid", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if str(root / p) in left_out or not (root / p).exists():
            continue
        if (root / p).is_dir():
            shutil.copytree(root / p, tmp_path / "repo" / p, ignore=lambda d, names: [n for n in names if n == "__pycache__" or f"{d}/{n}" in left_out])
        else:
            shutil.copy(root / p, tmp_path / "repo" / p)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(n[:2] == 'op' for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, with_sql, text_queries, pipeline = said.stdout.split()
    here = entry.queries()
    assert int(n) >= len([q for q in here if q[:2] != "op" and q != "pipeline"]) and int(with_sql) > 120
    assert pipeline == "False" and (text_queries == "0" or not any("llm" in g for g in gone))
