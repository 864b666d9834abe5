"""The SQL of these queries gives their rows, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from palimpsest.llm.oracles import ORACLES
from palimpsest.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))
