"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "item"):
        return plain(v.item())
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_queries_against_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    names = [n for n in sql if not n.startswith("op") and n != "pipeline"]

    def differs(name):
        frame = queries[name](spark, SF)
        columns = sorted(frame.columns)
        got = sorted(repr([plain(v) for v in r]) for r in frame.select(*columns).collect())
        rel = db.cursor().execute(sql[name])
        at = {c[0]: k for k, c in enumerate(rel.description)}
        return sorted(at) != columns or got != sorted(repr([plain(r[at[c]]) for c in columns]) for r in rel.fetchall())

    # planning takes most of the time on tables this small, so several queries go at once
    with ThreadPoolExecutor(6) as pool:
        wrong = [name for name, bad in zip(names, pool.map(differs, names), strict=True) if bad]
    assert wrong == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["class_name", "gt", "tp", "fn", "fp", "recall", "precision"]


def test_library_stands_without_the_corpus_part():
    """A copy of the repository without the corpus operators still imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    import tempfile

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(f"{top}/boxquarry", f"{d}/boxquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{top}/__spark_entry__.py", d)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=d, capture_output=True, text=True, check=True)
    n, some = said.stdout.split()
    assert int(n) > 100 and some == "False"
