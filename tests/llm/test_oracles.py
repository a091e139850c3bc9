"""Every query with SQL beside it against DuckDB."""

import duckdb
import pytest

import __spark_entry__
from lakesieve.llm.oracles import ORACLES

Q = __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    df = Q[name](spark, sf)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
