"""The registered queries of sharding and quality rules against recomputation, over nulls, repeats, ties and unbroken texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadastra.llm import quality_rules as qr
from cadastra.llm.common import WordHashes
from cadastra.llm.minhash import near_classes
from cadastra.llm.queries import QUERIES
from test_models import brute_statistics, labelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, kept boolean"


def write(spark, path, rows):
    spark.createDataFrame([(i, t, None, None, None, 7, 7, 7.0, True) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")


def test_op9(spark, tmp_path):
    rows = list(enumerate(t for t, _ in labelled()))
    extra = [(5000, None), (5001, ""), (None, rows[0][1]), (7, rows[7][1]), (5002, "x" * 200_000), (5003, "same words here " * 50), (5004, "漢字 " * 30)]
    write(spark, tmp_path, rows + extra)
    known = [(i, y) for i, (_, y) in enumerate(labelled())]
    spark.createDataFrame([(i, y, 0) for i, y in known] + [(None, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op9_quality_rules"](spark, str(tmp_path)).collect()
    # the trees again: only from labelled rows whose remainder isn't 0
    learn = [(i, t, y) for (i, t), (_, y) in zip(rows, known) if zlib.crc32(str(i).encode()) % 5]
    x = np.array([qr.statistics(t, WordHashes())[1] for _, t, _ in learn])
    trees = qr.fit_trees(x, np.array([float(y) for *_, y in learn]), list(qr.FEATURES.values()))
    texts = dict(rows) | dict(extra)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows + extra)
    for r in got:
        t = texts[r["doc_id"]]
        n, chars, symbols, dup, repeat = brute_statistics(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        failed = n < 10 or 100 * repeat > 20 * n
        score = float(trees.score(np.array([qr.statistics(t, WordHashes())[1]]))[0])
        assert r["base_failed"] == failed and r["score"] == pytest.approx(score, abs=1e-6) and r["kept"] == (not failed and score >= 0.3)


def test_op4(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab cdé\n", k=rng.randint(0, 900)))) for i in range(1500)] + [(None, "no id " * (k % 7)) for k in range(200)] + [(9, "again")] * 150 + [(8000, None), (8001, "z" * 150_000)]
    write(spark, tmp_path, rows)
    got = QUERIES["op4_kd_shards"](spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(16)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    whole, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    # no shard is further from its share than by the largest document and what the medians may be off
    assert all(abs(sum(r["size"] for r in by[s]) - whole / 16) <= largest + 0.01 * whole for s in range(16))
    again = QUERIES["op4_kd_shards"](spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in again) == Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in got)


def test_op3_on_unbroken_and_hot_texts(spark):
    """One bucket that needs several salts, texts without spaces, and a family whose members differ too much from each other."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:58], f"v{i}", f"u{i}"])) for i in range(1200)] + [(2000, "x" * 150_000), (2001, "X" * 150_000), (2002, "y" * 150_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(1200)} == {(56, 0)} and got[2000] == got[2001] == (1, 2000) and got[2002] == (1, 2002)
