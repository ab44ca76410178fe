"""The pipeline's near-dedup links at a similarity of 0.80, with bands that are made for it."""

import random

import corpus_pipeline as cp
from cadastra.llm.minhash import BINS, band_rows
from test_dedup import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def firsts(texts, percent):
    """The positions that lead their components when texts are linked from `percent` on."""
    sets, comp = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return {i for i, c in enumerate(comp) if c == i}


def pairs_at_80():
    """40 pairs of 95 words whose last 10 differ: 81 of 101 shingles in common, 0.802; and 40 pairs just below 0.80."""
    out = []
    for k in range(80):
        base, tail = [f"p{k}w{i}" for i in range(95)], 10 if k < 40 else 11
        out += [" ".join(base), " ".join(base[: 95 - tail] + [f"p{k}x{i}" for i in range(tail)])]
    random.Random(4).shuffle(out)
    return out


def test_stage_links_from_80(spark):
    texts = pairs_at_80()
    docs = spark.createDataFrame([(i, t, "aa", "s", None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"] for r in cp.minhash_near_dedup(spark, docs, "").collect()}
    assert len(firsts(texts, 85)) == 160 and len(firsts(texts, 80)) == 120
    assert got == firsts(texts, 80)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {rows[i]["doc_id"] for i in firsts([r["text"] for r in rows], 80)}
    assert {r["doc_id"] for r in cp.minhash_near_dedup(spark, docs, "").collect()} == want


def test_bands():
    assert (band_rows(85), band_rows(80)) == (8, 6)
    assert all((1 - (p / 100) ** band_rows(p)) ** (BINS // band_rows(p)) <= 1 / 25_000 for p in range(50, 101))
