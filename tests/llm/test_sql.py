"""The queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW \"{f.removesuffix('.parquet')}\" AS SELECT * FROM read_parquet('{D}/{f}')")
    theirs = con.execute(queries.SQL[name]).df()
    ours = queries.QUERIES[name](spark, D).toPandas()[list(theirs.columns)]
    key = lambda df: sorted(tuple("" if v != v or v is None else str(v).removesuffix(".0") for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
    assert key(ours) == key(theirs)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, D).count() >= 0
