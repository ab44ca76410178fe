"""The pipeline's stages and run() against brute force on small documents."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from cadastra.llm.common import cut
from test_dedup import squeezed
from test_layout import brute_targets
from test_near_stage import firsts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    kinds = {"aa": ["the", "and", "with", "house", "water", "stone"], "bb": ["der", "und", "nicht", "haus", "wasser", "stein"]}
    texts = [(k, " ".join(rng.choices(w, k=rng.randint(8, 60)))) for _ in range(60) for k, w in kinds.items()]
    texts += [(k, t + " ") for k, t in texts[:10]] + [(k, t.replace(" ", "  ", 1)) for k, t in texts[:5]]
    texts += [(k, t + " end") for k, t in texts if len(t.split()) > 40][:15]
    texts += [("aa", None), ("aa", ""), ("bb", "12 34"), ("aa", "!!!")]
    return [(i, t, k, f"s{i % 3}" if i % 7 else None, None) for i, (k, t) in enumerate(texts)]


def test_run(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        assert docs.columns[:5] == cp.COLUMNS
    # language ID: what has no letter goes, the rest stays
    assert {r["doc_id"] for r in seen["language_id"]} == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    # exact dedup: the longest original of each squeezed text
    best = {}
    for r in seen["language_id"]:
        key = squeezed(r["text"])
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x["text"]), x["doc_id"]))
    assert {r["doc_id"] for r in seen["exact_dedup"]} == {r["doc_id"] for r in best.values()}
    # near dedup: the first of each component
    left = sorted(seen["exact_dedup"], key=lambda r: r["doc_id"])
    first = firsts([r["text"] for r in left], cp.NEAR)
    assert {r["doc_id"] for r in seen["minhash_near_dedup"]} == {r["doc_id"] for i, r in enumerate(left) if i in first}
    # mixing: rows repeat; words near targets
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in seen["minhash_near_dedup"]:
        sizes[r["source"]] += len(r["text"].split())
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    for r in seen["mixing"]:
        taken[r["source"]] += len(r["text"].split())
    target = brute_targets(dict(sizes))
    assert max(copies.values()) <= 3 and all(abs(taken[s] - target[s]) <= 61 for s in sizes)
    # encoding: all rows, and the texts come back
    last = seen["sentencepiece"]
    assert Counter(r["doc_id"] for r in last) == copies and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) > 0 for r in last)
    whole = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in whole) == Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in last)


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """Different texts under one doc_id and texts without one are judged one by one; repeated rows stay once, then are mixed."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(90)], k=n))
    a, b, c, d = text(30), text(40), text(50), text(300)
    near = d + " and so on"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c + " ", "en", "s", 1), (None, c, None, "s", 1), (2, d, "en", "t", 1), (None, near, "en", "t", 1), (5, "q r", None, None, None)]
    rows += [(1, a, "en", "s", 1)] * 200
    docs = spark.createDataFrame(rows, SCHEMA)
    exact = cut(cp.exact_dedup(spark, docs, ""), "exact")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact.collect()) == sorted([(1, a), (1, b), (0, c + " "), (2, d), (0, near), (5, "q r")])
    kept = cut(cp.minhash_near_dedup(spark, exact, ""), "near")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (0, c + " "), (2, d), (5, "q r")])
    # near-dedup by itself over rows with repeats
    alone = cp.minhash_near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in alone if "w" in r["text"][:1]) in (sorted([(1, a), (1, b), (0, c), (2, d)]), sorted([(1, a), (1, b), (0, c + " "), (2, d)]))
    mixed = cp.mixing(spark, docs, "").collect()
    words, taken, target = Counter(), Counter(), None
    for r in rows:
        words[r[3]] += len(r[1].split())
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    target = brute_targets(dict(words))
    assert all(abs(taken[s] - target[s]) <= 30 for s in words) and any(r["doc_id"] is None for r in mixed)
    coded = cp.sentencepiece(spark, docs, "").collect()
    assert len(coded) == len(rows) and all(r["round_trip"] for r in coded)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and out.columns[:5] == cp.COLUMNS


def test_numbers_follow_doc_ids(spark):
    rows = [(i % 7 if i % 11 else None, f"t{i % 5}", "en", "s", 1) for i in range(300)]
    got = cp._numbered(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows) and len({r["_id"] for r in got}) == 300
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["_id"])]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))
    own = [(i, "t", None, None, None) for i in (5, 3, 9)]
    assert {r["doc_id"]: r["_id"] for r in cp._numbered(spark.createDataFrame(own, SCHEMA)).collect()} == {5: 5, 3: 3, 9: 9}
