"""Queries with SQL, side by side with DuckDB, and the two checks that need none."""

import glob
import os

import duckdb
import pytest

from loomgraph.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, data_dir, name):
    con = duckdb.connect()
    for path in glob.glob(data_dir + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = Q.QUERIES[name](spark, data_dir)
    rel = con.sql(Q.SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert sorted(map(str, ([r[c] for c in columns] for r in df.collect()))) == sorted(map(str, ([r[rel.columns.index(c)] for c in columns] for r in rel.fetchall())))


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p5_found", "p9_found"])
def test_results_are_distinct(spark, data_dir, name):
    rows = Q.QUERIES[name](spark, data_dir).collect()
    assert rows and len(rows) == len(set(rows))
