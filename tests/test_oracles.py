"""A few queries against their DuckDB oracle on sf0.001 (the full run is tools/compare_oracles.py)."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

from .conftest import SF

NAMES = ["html_tokens", "text_nodes", "url_validation", "noise_filter_core", "summarize_documents", "normalize_lines"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["pages", "documents"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want
