"""The quality classifier's word vectors come from all documents, labelled or not, and keep words apart; its scores are calibrated."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import quality_classifier as qc
from cadastra.llm.queries import QUERIES


def brute_vectors(texts, words):
    reader = qc.Reader(words)
    index = qc.index_vectors(qc.OWN + len(words)).astype(float)
    want = 0.5 * index
    for t in texts:
        at = reader.read([t])[0]
        for i in range(len(at)):
            for j in range(max(0, i - qc.REACH), min(len(at), i + qc.REACH + 1)):
                if i != j:
                    want[at[i]] += index[at[j]]
    return want / (np.linalg.norm(want, axis=1, keepdims=True) + 1e-9)


def test_vectors_cover_unlabelled_documents(spark):
    texts = ["good clean words here", "bad bad noise", "quokka beside a river", None, "", "river quokka AGAIN again", "x" * 200_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, token string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    model = qc.fit(docs, labels, F.lit(False))
    assert {"quokka", "river", "good", "noise", "x" * 200_000} <= set(model.words) and sorted(model.words.values()) == list(range(qc.OWN, qc.OWN + len(model.words)))
    assert np.allclose(model.vectors, brute_vectors(texts, model.words), atol=1e-5)


def test_a_full_vocabulary_keeps_the_frequent(spark):
    texts = [" ".join(f"w{k}" for k in range(60) if i % (k + 1) == 0) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {f"w{k}": sum(i % (k + 1) == 0 for i in range(120)) for k in range(60)}
    # "w" and the digits are tokens of their own
    got = qc.vocabulary(docs, most=20)
    assert 0 < len(got) <= 20 and "w" in got
    inside = [counts["w" + t] for t in got if t != "w"]
    assert min(inside) > max(n for w, n in counts.items() if w[1:] not in got)
    reader = qc.Reader(got)
    assert reader.row("zzz") == reader.row("zzz") < qc.OWN <= reader.row("w")


def documents(seed=1, n=500):
    """Good and poor texts of the same lengths with the same share of repeated words: only the words and their company differ."""
    rng = random.Random(seed)
    good, bad, both = ([f"{p}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] for p in "gbz")
    rows = []
    for i in range(n):
        y = rng.random() < 0.5
        share = 0.2 + 0.1 * rng.random()
        words = [rng.choice(both) if rng.random() > share else rng.choice(good if y != (rng.random() < 0.1) else bad) for _ in range(60)]
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_words_alone_tell_and_scores_are_calibrated(spark):
    rows = documents(n=3000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = qc.fit(docs, labels, F.col("doc_id") % 3 == 0)
    got = {r["doc_id"]: r["score"] for r in qc.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    # expected calibration error over ten bins
    bins = np.array([min(int(10 * s), 9) for s, _ in held])
    s, y = np.array(held).T
    error = sum(abs(s[bins == k].mean() - y[bins == k].mean()) * (bins == k).mean() for k in range(10) if (bins == k).any())
    assert error < 0.05


def test_registered_query(spark, tmp_path):
    rows = documents(n=300)
    extra = [(1000, None), (1001, ""), (1002, rows[0][1]), (None, rows[1][1]), (rows[2][0], rows[2][1]), (1003, "y" * 300_000)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows] + [(i, t, None, None, None) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op1_quality_classifier"](spark, str(tmp_path)).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    key = lambda i: -1 if i is None else i
    assert sorted(key(r["doc_id"]) for r in got) == sorted([i for i, _, _ in rows] + [key(i) for i, _ in extra])
    # the model again, from all texts and the labels of rows that are not held out
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    words = qc.vocabulary(docs)
    vectors = qc.word_vectors(docs, words)
    assert np.allclose(vectors, brute_vectors([t for _, t, _ in rows] + [t for _, t in extra], words), atol=1e-5)
    reader = qc.Reader(words)
    learn = [(i, t, y) for i, t, y in rows if not held(i)]
    net = qc.fit_network(np.stack([qc.pooled(reader.read([t])[0], vectors) for _, t, _ in learn]).astype(float), np.array([float(y) for *_, y in learn]))
    texts = {i: t for i, t, _ in rows} | dict(extra)
    for r in got:
        want = float(net.score(qc.pooled(reader.read([texts[r["doc_id"]]])[0], vectors)[None])[0])
        assert r["held_out"] == held(r["doc_id"])
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["predicted"] == int(r["score"] >= 0.3)
