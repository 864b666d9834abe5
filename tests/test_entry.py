"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e
from palimpsest.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    def plain(x):
        return "" if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert e.entry(spark).columns == ["key", "value", "seq"]
    assert set(e.oracle_sql()) <= set(e.queries())
