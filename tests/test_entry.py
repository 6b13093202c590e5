"""Queries against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_what_the_operators_import():
    """The rest works where the training-data operators can't be imported, not only where they aren't there."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'), len(e.queries()) > 50)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
    assert out.stdout.split("\n")[-2] == "[] True", out.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["normalize_words", "duplicate_pairs", "severity_score", "baseline_split", "precision_by_source", "url_ancestor_chain", "contradiction_pairs", "glob_refs", "tool_contexts", "weak_refs", "load_semantics", "front_matter_kinds", "drift_pairs"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda d: sorted(str([None if v != v else float(v) if isinstance(v, int | float) or hasattr(v, "dtype") else v for v in row]) for row in d[columns].itertuples(index=False))
    assert plain(got) == plain(want)
