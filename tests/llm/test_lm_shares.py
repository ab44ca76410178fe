"""LM scoring in shares: the same scores, documents that go on in the next batch, and how much disk it takes at a time."""

import os
import random
import threading
import time

import pytest
from test_models import brute_scores

from cadastra.llm.lm_scoring import lm_scores


def test_shares_change_nothing(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(40)] + [None, "", "only", "a b c d"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # words and n-grams of a document come in several batches
    try:
        got = {r["doc_id"]: r for r in lm_scores(docs, shares=3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(brute_scores(texts, 3, 0.4)):
        assert got[i]["n_words"] == n and got[i]["log_score"] == pytest.approx(s)


def test_disk_at_a_time(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(20_000)]
    docs = [(i, " ".join(rng.choices(words, k=1000))) for i in range(1100)]
    rows = sum(len(set(ws)) + len(set(zip(ws, ws[1:]))) + len(set(zip(ws, ws[1:], ws[2:]))) for ws in (t.split() for _, t in docs))
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), spark.conf.get("spark.checkpoint.dir")]

    def used():
        total = 0
        for folder in folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    try:
                        total += os.stat(f"{at}/{name}").st_size
                    except FileNotFoundError:
                        pass
        return total

    floor, most, over = used(), [0], threading.Event()

    def watch():
        while not over.is_set():
            most[0] = max(most[0], used() - floor)
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).filter("n_words = 1000 AND log_score < 0").count() == len(docs)
    finally:
        over.set()
        watcher.join()
    # of 12 to 28 bytes for each n-gram of a document in one shuffle, two shuffles
    assert 0 < most[0] < 8 * rows
