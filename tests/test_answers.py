"""Injected models, JSON repair and citation links."""

import pytest
from pyspark.sql import functions as F

from cadastra.operators import answers as an


def test_json_repair(spark):
    rows = [('```json\n{"a": 1}\n```', '{"a": 1}'), ("Here: [1, 2]", "[1, 2]"), ("none", None), ("{broken", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", an.json_repair(F.col("t")))
    assert all((r["got"] or "").strip() == (r["want"] or "") for r in df.collect())


def test_clause_url(spark):
    rows = [("lep", "http://x", "A", "sec.4.1", "http://x#sec.4.1"), ("dcp", None, "Liverpool DCP Schedule 2", "dcp.1 a", "/doc-viewer?doc=liverpool-dcp-sch2&anchor=dcp.1+a"), ("dcp", None, "Other", "d", None), ("lep", None, "A", "s", None), ("act", "u", "A", "s", None)]
    df = spark.createDataFrame(rows, "k string, u string, t string, i string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", an.clause_url(*map(F.col, "kuti"))).collect())


def test_embed(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "t string")
    got = {r["text"]: r["embedding"] for r in an.embed(df, "t", an.hash_embedding(8), batch=1).collect()}
    assert set(got) == {"a b", "c"} and all(sum(x * x for x in v) == pytest.approx(1) for v in got.values())


def test_first_answer():
    def fails(_):
        raise RuntimeError("down")

    assert an.first_answer([fails, str.upper], "x") == "X"
    with pytest.raises(RuntimeError):
        an.first_answer([fails], "x")
