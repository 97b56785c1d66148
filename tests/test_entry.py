"""The entry file: with and without the training-data subpackage, and every query against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tidemark import queries as engine

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, m, some = out.stdout.split()
    assert int(n) >= int(m) >= 40 and some == "False"


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "tidemark.llm" not in file.read_text(), file


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = connection.execute(engine.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = engine.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)
