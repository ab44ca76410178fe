"""Language ID, quality, pieces and LM scores against brute force, round trips and held-out rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import language_id as lid
from cadastra.llm import lm_scoring as lm
from cadastra.llm import quality_classifier as qc
from cadastra.llm import quality_rules as qr
from cadastra.llm import sentencepiece_codec as sc
from cadastra.llm.common import WordHashes
from cadastra.llm.pieces import MARK, MODEL, lattice, load

ODD = [None, "", " ", "  two  ", "\n\n a\n", "▁", "a▁ b ▁▁", "naïve 東京 \U0001f600", "\x00", "x" * 5000, "tab\tand\r\nline ", "7 8 9", "word " * 20000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i), None, None, None, "x") for i, t in enumerate(texts)], SCHEMA)


def test_codec_round_trip(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r["doc_id"]: r for r in sc.encode_documents(frame(spark, ODD)).collect()}
    assert all(rows[i]["round_trip"] and rows[i]["n_pieces"] == len(rows[i]["ids"]) for i in range(len(ODD)))
    assert rows[0]["ids"] == rows[1]["ids"] == []
    back = {r["doc_id"]: r["text"] for r in sc.decode_documents(sc.encode_documents(frame(spark, ODD))).collect()}
    assert [back[i] for i in range(len(ODD))] == [t or "" for t in ODD]
    for i, t in enumerate(ODD):
        if t and MARK not in t:
            assert sp.decode(rows[i]["ids"]) == t
    assert sc.encode_documents(frame(spark, []).limit(0)).count() == 0


def test_codec_finds_the_best_path():
    v = load()
    score = {p: v.scores[i] for i, p in enumerate(v.pieces) if v.bytes_of[i] and not (p.startswith("<0x") and len(p) == 6)}
    rng = random.Random(4)
    words = [MARK + "".join(rng.choices("theanding éq漢", k=rng.randint(1, 9))).replace(" ", MARK) for _ in range(150)]
    for word, ids in zip(words, sc.best_paths(words, v)):
        best = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            best[j] = max([best[j - 1] + sc.BYTES] + [best[k] + score[word[k:j]] for k in range(max(0, j - v.longest), j) if word[k:j] in score])
        raw = sum(v.pieces[i].startswith("<0x") for i in ids)
        assert raw or sum(v.scores[i] for i in ids) == pytest.approx(best[-1])


def test_forward_sums_all_segmentations():
    v = load()
    p = np.random.default_rng(0).random((len(v.pieces), 2)) * 1e-3
    ids = {x: i for i, x in enumerate(v.pieces) if v.bytes_of[i] and not x.startswith("<0x")}
    for word in (MARK + "the", MARK + "inga", "é漢a"):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            segs = [word[a:b] for a, b in itertools.pairwise(at)]
            options = []
            for s in segs:
                o = ([p[ids[s]]] if s in ids else []) + ([np.full(2, lid.STRANGE)] if len(s) == 1 else [])
                options.append(sum(o) if o else np.zeros(2))
            total += np.prod(options, axis=0)
        assert np.exp(lid.forward([word], p, v)[0][0]) == pytest.approx(total)
        got, share = lid.expected([word], np.array([3.0]), p[:, 0], v)
        assert set(got) == set(lattice([word], v.automaton).piece) and (share <= 3 * len(word)).all()


def language_texts():
    rng = random.Random(5)
    kinds = {"aa": ["the", "and", "with", "house", "water"], "bb": ["der", "und", "nicht", "haus", "wasser"], "cc": ["el", "y", "con", "casa", "agua"]}
    return [(k, " ".join(rng.choices(w, k=40))) for k, w in kinds.items() for _ in range(30)]


def test_language_id(spark):
    rows = language_texts()
    docs = frame(spark, [t for _, t in rows] + ODD, {i: k for i, (k, _) in enumerate(rows)})
    models = lid.fit(docs, F.col("doc_id") % 3 == 1)
    assert models.languages == ["aa", "bb", "cc"] and np.allclose(models.p.sum(axis=0), 1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lid.identify(docs, models).collect()}
    assert all(got[i][0] == k for i, (k, _) in enumerate(rows))
    for i, t in enumerate(ODD):
        und = not any(c.isalpha() for c in t or "")
        assert (got[len(rows) + i] == ("und", 0.0)) == und
    assert all(0 <= s <= 1 for _, s in got.values())
    none = lid.fit(docs.limit(0), F.lit(False))
    assert {r["lang_pred"] for r in lid.identify(docs, none).collect()} == {"und"}


def labelled():
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    good = [" ".join(rng.choices(words, k=80)) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=80)) for _ in range(40)] + [" ".join(w + "***" for w in rng.choices(words, k=80)) for _ in range(40)]
    return [(t, 1) for t in good] + [(t, 0) for t in bad]


def test_quality_classifier(spark):
    rows = labelled()
    docs = frame(spark, [t for t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 4 == 0
    model = qc.fit(docs, labels, held)
    got = {r["doc_id"]: r for r in qc.score(docs, model).collect()}
    wrong = sum(got[i]["predicted"] != y for i, (_, y) in enumerate(rows) if i % 4 == 0)
    assert wrong <= 2 and len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got.values())
    again = qc.fit(docs, labels, held)
    assert np.allclose(again.vectors, model.vectors) and {r["doc_id"]: r["score"] for r in qc.score(docs, again).collect()} == pytest.approx({i: r["score"] for i, r in got.items()})
    assert qc.score(docs, qc.fit(docs, labels.limit(0), held)).count() == len(got)


def brute_statistics(t):
    words = [w for w in (t or "").translate({ord(c): " " for c in " \t\n\x0b\x0c\r"}).split(" ") if w]
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_statistics():
    rng = random.Random(7)
    texts = ODD[:-1] + ["".join(rng.choices("ab \n#|", k=rng.randint(0, 400))) for _ in range(60)] + ["a b c d e f a b c d e", "x\nx\n \n \nx"]
    for t in texts:
        assert qr.statistics(t, WordHashes())[0] == brute_statistics(t)


def test_quality_rules(spark):
    rows = labelled()
    docs = frame(spark, [t for t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    trees = qr.fit(docs, labels)
    got = {r["doc_id"]: r for r in qr.judge(docs, trees).collect()}
    assert sum(got[i]["kept"] != bool(y) for i, (_, y) in enumerate(rows)) <= 2
    assert all(got[len(rows) + i]["base_failed"] for i in (0, 1, 2, len(ODD) - 1)) and not any(r["kept"] and r["base_failed"] for r in got.values())
    assert qr.judge(docs, qr.fit(docs, labels.limit(0))).filter("not base_failed and not kept").count() == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(8)
    x = rng.random((2000, 8))
    y = (rng.random(2000) < 1 / (1 + np.exp(8 * x[:, 2] - 4 + 3 * np.sin(9 * x[:, 2])))).astype(float)
    trees = qr.fit_trees(x, y, list(qr.FEATURES.values()))
    for k, sign in enumerate(qr.FEATURES.values()):
        if sign:
            z = np.repeat(x[:50], 40, axis=0)
            z[:, k] = np.tile(np.linspace(0, 1, 40), 50)
            assert (np.diff(trees.score(z).reshape(50, 40), axis=1) <= 1e-12).all()


def brute_scores(texts, order, alpha):
    docs = [[w for w in (t or "").translate({ord(c): " " for c in " \t\n\x0b\x0c\r"}).split(" ") if w] for t in texts]
    grams = lambda ws: Counter(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    every, total, out = sum((grams(d) for d in docs), Counter()), sum(map(len, docs)), []
    for d in docs:
        own, s = grams(d), 0.0
        left = lambda g: every[g] - own[g]  # noqa: E731, B023
        for i in range(len(d)):
            can = min(order, i + 1)
            for k in range(can, 0, -1):
                g = tuple(d[i - k + 1 : i + 1])
                if left(g) > 0:
                    s += math.log(alpha ** (can - k) * left(g) / (left(g[:-1]) if k > 1 else total - len(d)))
                    break
            else:
                s += math.log(alpha**can / total)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 40))) for _ in range(60)] + [None, "", " \n", "zz", "a b " * 200] + ["a b c d"] * 10
    got = {r["doc_id"]: r for r in lm.lm_scores(frame(spark, texts), order=order).collect()}
    for i, (n, s) in enumerate(brute_scores(texts, order, 0.4)):
        assert got[i]["n_words"] == n and got[i]["log_score"] == pytest.approx(s)
        assert (got[i]["mean_log_score"] is None) == (n == 0)
    assert lm.lm_scores(frame(spark, []).limit(0)).count() == 0


def test_lm_scores_of_repeated_rows_and_null_ids(spark):
    texts = ["a b c a b", "a b c a b", "b c d", None, "", "c d e a b c", "漢 漢 漢", "x" * 200_000 + " a"]
    ids = [1, 1, None, None, 4, None, 7, 8]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n int, gram long, left string")
    got = lm.lm_scores(docs).collect()
    want = sorted((i or 0, n, round(s, 6)) for i, (n, s) in zip(ids, brute_scores(texts, 3, 0.4)))
    assert sorted((r["doc_id"] or 0, r["n_words"], round(r["log_score"], 6)) for r in got) == want
