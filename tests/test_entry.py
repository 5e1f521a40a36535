import duckdb
import pytest

import __spark_entry__ as e
from pairsmith.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(value):
    return None if value is None else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(same(r[c]) for c in columns)) for r in frame.collect())
    found = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(same(r[k]) for k in order)) for r in found.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_operators():
    """The contract holds where that subpackage has been taken out."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "pairsmith.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "dpo_pairs" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in [*e.queries(), *e.oracle_sql()])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(e.__file__).parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
