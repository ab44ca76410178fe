"""Use hits against the rule of the surveyed code, tokens that stand apart included."""

from collections import Counter

from cadastra.plans.property import use_hit, use_hits

ROOT = "/root/testdata/sf0.001"


def hit(question, use):
    return use in question or all(len(t) > 3 and t in question for t in use.split())


def test_rule(spark):
    questions = ["may i build a dwelling, or a dual occupancy house here", "boarding houses and shops", "a pub", "", "red rooms"]
    uses = ["dual house", "boarding houses", "dwelling house", "a pub", "pub", "red rooms", "rooms red", "shop", "houses boarding", "house", "Dwelling House", "i", "occupancy  dual"]
    asked = spark.createDataFrame(list(enumerate(questions)), "id int, question string")
    got = use_hits(asked, spark.createDataFrame([(u,) for u in uses], "use string")).collect()
    want = [(i, u) for i, q in enumerate(questions) for u in uses if hit(q, u.lower())]
    assert (0, "dwelling house") in want and (4, "rooms red") not in want
    assert sorted((r["id"], r["use"]) for r in got) == sorted(want)


def test_query_counts_both_branches(spark):
    part = spark.read.parquet(f"{ROOT}/part.parquet").select("p_partkey", "p_type", "p_name").collect()
    uses = {r["p_name"] for r in part}
    want = Counter(r["p_partkey"] for r in part for u in uses if hit(f"{r['p_type']} {r['p_name']} works".lower(), u))
    assert {r["p_partkey"]: r["n_hits"] for r in use_hit(spark, ROOT).collect()} == dict(want)
    assert sum(want.values()) == 283
