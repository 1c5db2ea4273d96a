"""The entry module, and every registered query with a SQL twin, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from ridgeline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, db, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr(tuple(r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without their folders imports and registers the other queries; a dependency
    that is missing inside them is not hidden."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "ridgeline", tmp_path / "ridgeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    go = lambda: subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert go().stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]
    (tmp_path / "ridgeline" / "llm").mkdir()
    (tmp_path / "ridgeline" / "llm" / "__init__.py").write_text("")
    (tmp_path / "ridgeline" / "llm" / "registry.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_module" in go().stderr
