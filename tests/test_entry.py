"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SAMPLE = ["equi_join", "antijoin", "count_where_zero", "argmin_all_ties", "closure_right", "widest_path_minmax", "csv_unpivot_keys", "batch_run"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in got.collect())


def test_imports_without_the_operators(tmp_path):
    import pathlib
    import shutil

    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "ruleweave", tmp_path / "ruleweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(k.startswith('op') for k in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
