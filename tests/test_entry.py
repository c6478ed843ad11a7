"""The driver's contract: names, columns, SQL, and life without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "paperlake"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "paperlake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)


@needs_tables
@pytest.mark.parametrize("name", ["s3_content_address", "p4_abstracts", "c1_references", "f2_decide", "q1_citing_papers", "v2_word_windows", "u6_resolve_drafts", "h2_route_queries"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings events lineitem benchmark orders".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, row, strict=True))]) for row in cur.fetchall())
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert sorted(repr([plain(v) for v in row]) for row in df.select(*cols).collect()) == want


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "is_integer") else v


@needs_tables
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["paper_id", "n_in", "n_out"] and df.count() > 0
