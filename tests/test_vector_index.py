"""Inverted lists: recall against a full search, the lists read, and the certain search, over clusters, ties, nulls and hot lists."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.operators.retrieval import batch_vector_search
from cadastra.operators.vector_index import Lists, _nearest, _unit, build_index, recall, search_index, share_read
from cadastra.plans import retrieval  # noqa: F401
from cadastra.plans.registry import QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    """40 groups of directions, a third of all rows in one of them, with repeats, zeros, nulls and an id for several rows."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    of = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    x = centres[of] + rng.normal(size=(3000, 16)) * 0.25
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000 + i, x[7].tolist()) for i in range(15)] + [(5000, [0.0] * 16), (5001, None), (None, x[3].tolist())]
    return spark.createDataFrame(rows, "k long, e array<double>")


def queries(df, every=50):
    return df.filter(F.col("k") % every == 0).select(F.col("k").alias("query_id"), F.col("e").alias("vector"))


def tuples(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())


def test_recall_and_reads(spark, data, tmp_path):
    path = f"{tmp_path}/index"
    build_index(data, path, "k", "e", most=1500)
    asked = queries(data)
    exact = batch_vector_search(data.filter("k IS NOT NULL"), asked, 10, id_col="k", column="e")
    found = search_index(spark, path, asked)
    assert recall(found, exact) >= 0.9 and share_read(spark, path, asked) < 0.5
    lists = Lists(spark, path)
    assert lists.sizes.sum() == 3016 and len(lists.sizes) == 54 and lists.probes < 27
    # a certain search and one of all lists are the full search
    assert tuples(search_index(spark, path, asked, probes=1, certain=True)) == tuples(exact)
    assert tuples(search_index(spark, path, asked, probes=len(lists.sizes), most=7)) == tuples(exact)
    # only the folders of the lists asked for are read
    q = _unit(np.array([asked.first()["vector"]]))
    plan = _nearest(lists, np.array([0]), q, lists.probed(q, 2), 10, 6)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        plan.explain("formatted")
    wanted = np.flatnonzero(lists.probed(q, 2)[0]).tolist()
    assert any("PartitionFilters" in line and all(str(i) in line for i in wanted) for line in out.getvalue().splitlines())


def test_edges(spark, data, tmp_path):
    path = f"{tmp_path}/few"
    build_index(data.limit(5), path, "k", "e")
    few = batch_vector_search(data.limit(5), queries(data, 500), 10, id_col="k", column="e")
    assert tuples(search_index(spark, path, queries(data, 500))) == tuples(few)
    nothing = search_index(spark, path, queries(data).limit(0))
    assert nothing.columns == ["query_id", "id", "distance", "rank"] and nothing.count() == 0
    with pytest.raises(ValueError):
        build_index(data.filter("e IS NULL"), f"{tmp_path}/none", "k", "e")


def test_registered(spark):
    """On directions without any groups, the worst case for lists, recall stays over 0.9."""
    assert recall(QUERIES["vec_index"](spark, ROOT), QUERIES["multi_query_batch"](spark, ROOT)) >= 0.9
