"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestrata.plans import corpus, training

D = "/root/testdata/sf0.001"
NAMES = sorted(corpus.SQL | training.SQL)


def canonical(df):
    df = df[sorted(df.columns)]
    text = lambda v: "" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW \"{f.removesuffix('.parquet')}\" AS SELECT * FROM read_parquet('{D}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    ours = entry.queries()[name](spark, D).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted((corpus.QUERIES | training.QUERIES).keys() - set(NAMES)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, D).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
