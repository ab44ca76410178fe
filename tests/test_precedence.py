"""Precedence in rounds by level against the comparison of all pairs in order, and what overrides what."""

import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from cadastra.operators.precedence import decisions, precedence
from cadastra.operators.retrieval import overrides_block

SCHEMA = "query_id long, pos long, id long, document_id string, level int, type string, subject string, extra string"


def greedy(items):
    """The rule as it is written down: (those that go out, all pairs in which a candidate puts another out that is still in)."""
    norm = [" ".join(re.sub("[^a-z0-9 ]+", " ", (r[6] or "").lower()).split()) for r in items]
    out, pairs = set(), set()
    for i, a in enumerate(items):
        if i in out:
            continue
        for j in range(i + 1, len(items)):
            b, x, y = items[j], norm[i], norm[j]
            like = x and y and (x == y or (min(len(x), len(y)) >= 6 and (x in y or y in x)))
            if j in out or not like or None in (a[3], b[3], a[4], b[4], a[5], b[5]) or a[3] == b[3] or a[5] != b[5] or a[4] == b[4]:
                continue
            w, k = (i, j) if a[4] < b[4] else (j, i)
            out.add(k)
            pairs.add((items[w][2], items[k][2]))
    return {items[k][2] for k in out}, pairs


def test_against_all_pairs(spark):
    rng = random.Random(3)
    subjects = ["dwelling", "dwelling house", "Dwelling-House!", "house", "secondary dwelling house", "shop", "shops", "", "!!", None, "x"]
    rows, n = [], 0
    for q in range(40):
        for pos in rng.sample(range(200), rng.choice([0, 1, 5, 60, 60])):
            rows.append((q, pos, n, rng.choice(["A", "B", "C", "D", None]) if rng.random() < 0.9 else f"D{n}", rng.choice([1, 2, 3, 4, 4, None]), rng.choice("tttuu") if rng.random() < 0.95 else None, rng.choice(subjects), "x"))
            n += 1
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out, pairs = set(), set()
    for items in by.values():
        a, b = greedy(sorted(items, key=lambda r: r[1]))
        out |= a
        pairs |= b
    judged = precedence(spark.createDataFrame(rows, SCHEMA))
    got = judged.collect()
    assert sorted(tuple(r)[:8] for r in got if None not in tuple(r)[:8]) == sorted(r for r in rows if None not in r) and len(got) == len(rows)
    assert {r["id"] for r in got if not r["kept"]} == out and len(out) > 100
    told = decisions(judged)
    found = [(r["winner_id"], r["loser_id"]) for r in told.collect()]
    assert len(found) == len(out) and set(found) <= pairs
    line = told.select(overrides_block(told)).first()[0]
    assert re.fullmatch(r'  • ".*" from \S+ \(level [1-4]\) overridden by \S+ \(level [1-4]\)', line)


def test_one_group_of_many(spark):
    """20,000 candidates of one query and one subject; the first pairs that the rule would make are over a hundred million."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("pos"), "id", F.concat(F.lit("D"), (F.col("id") % 5000).cast("string")).alias("document_id"), F.when(F.col("id") == 15_000, 1).otherwise(3 + F.col("id") % 2).cast("int").alias("level"), F.lit("t").alias("type"), F.lit("dual occupancy").alias("subject"), F.lit("x").alias("extra"))
    began = time.time()
    got = {r["kept"]: r["n"] for r in precedence(rows).groupBy("kept").agg(F.count("*").alias("n")).collect()}
    # level 4 is out against level 3; level 3 against the one of level 1, but for those of its own document
    assert got[True] == 1 + 3 and sum(got.values()) == 20_000 and time.time() - began < 120


def test_no_candidates(spark):
    none = precedence(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[-2:] == ["kept", "winner_id"] and decisions(none).count() == 0
