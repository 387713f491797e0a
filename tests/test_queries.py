"""Every query of the library against its SQL in DuckDB."""

import math

import duckdb
import pytest

from docreef.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else str(x)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    q = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in q.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_the_optional_parts_may_be_missing():
    """Without the optional subpackage the entry offers the rest; a package that the subpackage lacks is an error."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == sys.argv[1]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
print(len(__spark_entry__.queries()))
"""
    run = lambda name: subprocess.run([sys.executable, "-c", code, name], cwd=root, capture_output=True, text=True, timeout=120)
    assert run("docreef.llm").stdout.strip() == str(len(QUERIES))
    if os.path.isdir(f"{root}/docreef/llm"):
        assert "xxhash" in run("xxhash").stderr and run("xxhash").returncode
