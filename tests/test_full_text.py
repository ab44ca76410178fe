"""Stems, the text index and cover density against known stems and brute force."""

import contextlib
import io
import itertools
import random

import pytest

from cadastra.functions.stems import Stems, positions, search_stems, stem
from cadastra.operators.full_text import BUCKETS, add_documents, bucket, index_search, indexed, postings, text_search

# words of the public description of the stemmer, with their stems
KNOWN = """
consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistent consist consolation consol
consolidate consolid consolingly consol conspicuous conspicu conspiracy conspiraci constable constabl constancy constanc knack knack knavish knavish
kneeling kneel knightly knight generously generous communism communism arsenal arsenal skies sky dying die idly idl early earli happy happi cries cri ties tie
gas gas this this kiwis kiwi gaps gap hopping hop hoping hope beds bed shed shed luxuriated luxuri say say by by enjoy enjoy youth youth relational relat conditional condit
valency valenc digitizer digit radically radic differently differ vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formality formal sensitivity sensit sensibility sensibl analogy analog triplicate triplic electrical electr goodness good revival reviv
allowance allow airliner airlin adjustable adjust replacement replac adoption adopt homologous homolog effective effect rate rate cease ceas controlling control
agreed agre feed feed proceeding proceed innings inning owned own national nation badly bad 2nd 2nd é é ée ée
""".split()


def test_known_stems():
    assert {w: stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2]))
    assert search_stems("The others and ponies of Ponies, 3 ering!") == ["other", "poni", "3", "ere"] and search_stems("the of and") == []


def brute(text, wanted):
    """Covers as all stretches that hold every stem and hold no shorter such stretch."""
    at = sorted((p, s) for s, ps in positions(text, Stems(), frozenset(wanted)).items() for p in ps)
    whole = [(i, j) for i in range(len(at)) for j in range(i, len(at)) if {s for _, s in at[i : j + 1]} == set(wanted)]
    least = [(i, j) for i, j in whole if not any((k, m) != (i, j) and i <= k and m <= j for k, m in whole)]
    return round(sum(0.1 / (1 + at[j][0] - at[i][0] - (j - i)) for i, j in least), 6)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["pony", "ponies", "House", "housing", "gate", "the", "of", "x", "y", "1800"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 6, 40])))) for i in range(120)] + [(500, None), (501, "ponies, houses: GATES. 1800"), (None, "pony house gate"), (502, "pony " * 5000 + "house")]


@pytest.mark.parametrize("asked", ["ponies", "a pony of houses", "the gate, house and pony", "1800 gates"])
def test_ranks(spark, texts, tmp_path, asked):
    wanted = search_stems(asked)
    scores = {i: brute(t, wanted) for i, t in texts if i is not None and i != 502}
    want = sorted(((-s, i) for i, s in scores.items() if s), key=lambda x: x)
    rows = spark.createDataFrame(texts, "id long, text string")
    got = [(-r["text_score"], r["id"]) for r in text_search(rows.filter("id IS NULL OR id <> 502"), asked, k=1000).orderBy("text_rank").collect()]
    assert got == want and len(got) > 10
    add_documents(rows.filter("id IS NULL OR id <> 502"), f"{tmp_path}/index")
    assert [(-r["text_score"], r["id"]) for r in index_search(spark, f"{tmp_path}/index", "none", (asked,), k=7).orderBy("text_rank").collect()] == want[:7]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_index(spark, texts, tmp_path):
    rows, path = spark.createDataFrame(texts, "doc long, body string"), f"{tmp_path}/index"
    assert indexed(spark, path) is None
    for part in ("doc < 60", "doc < 90", "doc < 90", "true"):
        add_documents(rows.filter(part), path, "doc", "body")
    # each document once, though most came more than once
    every = [(r["id"], r["stem"], list(r["positions"])) for r in spark.read.parquet(f"{path}/postings").collect()]
    assert sorted(every) == sorted((i, s, at) for i, t in texts if i is not None for s, at in positions(t, Stems()).items())
    assert indexed(spark, path).count() == len(texts) - 1
    found = index_search(spark, path, "ponies and houses", k=1000)
    told = plan(found)
    folders = sorted({bucket("poni", BUCKETS), bucket("hous", BUCKETS)})
    read = [r for r in told.splitlines() if "PartitionFilters" in r]
    assert read and all(str(x) in read[0] for x in folders) and "In(stem, [hous,poni])" in told and "positions" in told
    assert {r["id"]: r["text_score"] for r in found.collect()}[502] == 0.1
    # kept to some ids; nothing to ask for; nothing that all hold
    some = spark.createDataFrame([(501,), (502,), (7000,)], "id long")
    assert {r["id"] for r in index_search(spark, path, "ponies houses", among=some).collect()} == {501, 502}
    assert index_search(spark, path, "the of").count() == 0 and index_search(spark, path, "pony zebra").count() == 0
    assert text_search(rows, "the of", id_col="doc", column="body").count() == 0 and text_search(rows.limit(0), "pony", id_col="doc", column="body").count() == 0
    names = spark.createDataFrame([("a", "Pony"), ("b", "house")], "id string, text string")
    assert [r["id"] for r in text_search(names, "ponies").collect()] == ["a"] and postings(names).count() == 2
    assert len(set(itertools.chain.from_iterable((bucket(f"w{k}"),) for k in range(1000)))) == BUCKETS
