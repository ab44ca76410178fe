"""The operators' queries with SQL give the rows that DuckDB gives on the smallest tables."""

import duckdb
import pytest
from oracle_rows import rows

from cadastra.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got, want = QUERIES[name](spark, ROOT).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
