"""A database's table in ranges with pushed filters, and copies that are proven."""

import contextlib
import io
import sqlite3

import pytest
from pyspark.sql import functions as F

from cadastra.sources.database import DatabaseReader, copy_table, manifest, read_database

SCHEMA = "k long, name string, v double"


@pytest.fixture
def database(tmp_path):
    at = str(tmp_path / "lots.db")
    with contextlib.closing(sqlite3.connect(at)) as con:
        con.execute("CREATE TABLE lots (k INTEGER, name TEXT, v REAL)")
        con.executemany("INSERT INTO lots VALUES (?, ?, ?)", [(i, f"lot {i % 7}" if i % 11 else None, i / 2) for i in range(-50, 1000)] + [(None, "no key", None), (5, "again", 1.5)])
        con.commit()
    return at


def test_ranges_and_filters(spark, database):
    rows = read_database(spark, "sqlite3", [database], "lots", SCHEMA, "k", 0, 900, 5)
    # bounds that leave rows outside lose none
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 1052 and rows.filter("k IS NULL").count() == 1
    found = rows.filter("k >= 990 AND name = 'lot 3' AND v IS NOT NULL")
    assert sorted(r["k"] for r in found.collect()) == [k for k in range(990, 1000) if k % 7 == 3 and k % 11]
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain("formatted")
    # what was pushed is no filter of Spark's any more
    assert "(2) Filter" not in out.getvalue()
    assert rows.filter(F.col("name").isin("again", "no key")).count() == 2 and rows.filter("name LIKE '%gai%' AND k < 6").count() == 1 and rows.filter("name IS NULL").count() == len([k for k in range(-50, 1000) if k % 11 == 0])


def test_conditions():
    from pyspark.sql import datasource as ds
    from pyspark.sql.types import _parse_datatype_string as parsed  # noqa: F401

    class Schema:
        names = ["k", "na\"me"]

    reader = DatabaseReader({"key": "k", "lower": "0", "upper": "3", "ranges": "9"}, Schema())
    left = list(reader.pushFilters([ds.EqualTo(("k",), 5), ds.In(("k",), (1, 2)), ds.EqualTo(("other",), 5), ds.EqualTo(("k", "deep"), 5), ds.IsNull(("na\"me",)), ds.StringContains(("k",), "x")]))
    assert len(left) == 3 and reader.conditions == [('"k" = ?', [5]), ('"k" IN (?, ?)', [1, 2]), ('"na""me" IS NULL', [])]
    assert [p.value for p in reader.partitions()] == [(None, 0), (0, 1), (1, 2), (2, None)]


def test_copies(spark, tmp_path):
    source = spark.range(500).select("id", (F.col("id") % 7).alias("n"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s")).unionByName(spark.createDataFrame([(3, 3, "3"), (None, 1, None)], "id long, n long, s string"))
    path = f"{tmp_path}/copy"
    for _ in range(2):  # again, as after a failure
        told = copy_table(source, path, "id", 8).collect()
        assert all(r["same"] for r in told) and sum(r["copy_n"] for r in told) == 502 and sum(r["copy_keys"] for r in told) == 501
    copy = spark.read.parquet(path).drop("_part")
    for broken in (copy.filter("id <> 17 OR id IS NULL"), copy.unionByName(copy.filter("id = 17")), copy.withColumn("s", F.when(F.col("id") == 17, "x").otherwise(F.col("s")))):
        bad = [r["part"] for r in manifest(source, broken, "id", 8).filter("NOT same").collect()]
        assert len(bad) == 1
    assert all(r["same"] for r in copy_table(source, path, "id", 8, only=bad).collect())
