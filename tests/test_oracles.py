"""Every query with SQL gives the rows that DuckDB gives for it on the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from cadastra.plans import legal, property, relational, retrieval, streams, text  # noqa: F401
from cadastra.plans.registry import ORACLES, QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


# The smallest tables hold no lots and zones that meet.
LARGER = {"geometry_meets", "geometry_meets_inset", "spatial_bbox_join"}


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for root in (ROOT, ROOT.replace("0.001", "0.01")):
        out[root] = con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return out


def rows(frame):
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(one, r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, ducks, name):
    root = ROOT.replace("0.001", "0.01") if name in LARGER else ROOT
    got = QUERIES[name](spark, root).toPandas()
    assert len(got), "a query that finds nothing compares nothing"
    if name not in ORACLES:
        pytest.skip("no SQL")
    want = ducks[root].sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
