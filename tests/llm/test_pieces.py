"""Lattices of pieces: reused encoders, blocks without pieces, ties, long unbroken texts, and the registered queries."""

import math
import random
import zlib

import numpy as np
import pytest

from cadastra.llm import language_id as lid
from cadastra.llm import sentencepiece_codec as sc
from cadastra.llm.pieces import CUTS, MARK, Known, lattice, load, parts, uncrossed
from cadastra.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, lang_pred string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "x", "x", "x") for i, t, lang in rows], SCHEMA)


def brute_path(word, v):
    """Every cut of the word: the best sum; of equal sums the path whose last piece is the shortest, and so on."""
    ids = {p: i for i, p in enumerate(v.pieces) if v.bytes_of[i] and not (p.startswith("<0x") and len(p) == 6)}
    best = [(0.0, ())] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[j - 1][0] + sc.BYTES, (*best[j - 1][1], None))]
        options += [(best[k][0] + v.scores[ids[word[k:j]]], (*best[k][1], ids[word[k:j]])) for k in range(j - 1, max(-1, j - v.longest - 1), -1) if word[k:j] in ids]
        top = max(x[0] for x in options)
        same = [x for x in options if x[0] == top and x[1][-1] is not None] or options
        best[j] = next(x for x in same if x[0] == top)
    out, at = [], 0
    for x in best[-1][1]:
        out += [x] if x is not None else [v.byte_id[b] for b in word[at].encode()]
        at += len(v.pieces[x]) if x is not None else 1
    return out


def test_paths_with_bytes_ties_and_length():
    v, rng = load(), random.Random(4)
    words = [MARK + "".join(rng.choices("theandiнgqéfqz漢", k=rng.randint(1, 40))) for _ in range(150)]
    for w, ids in zip(words, sc.best_paths(words, v)):
        assert ids.tolist() == brute_path(w, v) == sc.best_path(w, v).tolist()
        split = uncrossed(w, v.automaton)
        assert "".join(split) == w and np.concatenate([sc.best_path(x, v) for x in split]).tolist() == ids.tolist()


def test_a_reused_encoder_meets_segments_without_pieces():
    v = load()
    e = sc.Encoder(v)
    for t in ["a", "a\n", "a\n\n", "漢漢", "\n", "a", "", "​​"]:
        assert sc.decode(e.encode([t])[0].tolist(), v) == t
    assert lid.forward(["漢漢", "\U0001f600"], np.full((len(v.pieces), 1), 1e-5), v)[0].shape == (2, 1)


def test_an_encoder_forgets_by_bytes():
    e = sc.Encoder(load(), most=5000)
    for i in range(50):
        assert sc.decode(e.encode([f"word{i} other{i * 7}"])[0].tolist(), e.v) == f"word{i} other{i * 7}"
        assert e.known.held < 8000 and len(e.known.new) + len(e.known.old) < 60
    known = Known(500)
    for i in range(40):
        for w in known.lacking({"often", f"w{i}"}):
            known.put(w, w.encode())
        assert known.joined(["often", f"w{i}"]) == f"oftenw{i}".encode()


@pytest.mark.parametrize("unit", ["thequickbrown", "漢字かな", "x"])
def test_unbroken_text_is_read_whole(unit):
    v, t = load(), (unit * 200_000)[:200_000]
    ids = sc.Encoder(v).encode([t])[0]
    assert sc.decode(ids.tolist(), v) == t
    want = sc.best_path(MARK + t, v)
    assert ids.tolist() == want.tolist()
    assert "".join(lid.text_words(t[:20_000], v)) == MARK + t[:20_000]


def test_long_words_sum_like_short_ones():
    v, rng = load(), random.Random(5)
    p = np.random.default_rng(0).random((len(v.pieces), 2)) * 1e-3
    for word in ["漢" * 43, "漢" * 63, "漢" * 500, "the" * 21, "x" * 300, "".join(rng.choices("the漢q", k=400))]:
        lat, n = lattice([word], v.automaton), len(word)
        logs = np.full((n + 1, 2), -np.inf)
        logs[0] = 0
        for e in range(1, n + 1):
            terms = [logs[e - 1] + math.log(lid.STRANGE), *[logs[s] + np.log(p[i]) for s, i in zip(lat.start[lat.end == e], lat.piece[lat.end == e])]]
            logs[e] = np.logaddexp.reduce(np.stack(terms), axis=0)
        assert np.allclose(lid.forward([word], p, v)[0][0], logs[-1])
        split = [lid.forward([x], p, v)[0][0] for x in uncrossed(word, v.automaton)]
        assert np.allclose(np.sum(split, axis=0), logs[-1])
        if n <= lid.LONG:
            ids, share = lid.expected([word], np.array([2.0]), p[:, 0], v)
            long = 2 * lid._long_expected(word, p[:, 0], v)
            assert np.allclose([long[lat.piece == i].sum() for i in ids], share)


def test_parts():
    for sizes in ([], [5], [3, 0, 9, 2, 2, 50, 1], [10] * 7):
        got = list(parts(np.array(sizes, np.int64), 10))
        assert [i for s in got for i in range(s.start, s.stop)] == list(range(len(sizes)))
        assert all(sum(sizes[s.start : s.stop - 1]) <= 10 for s in got)


def test_made_names_may_not_be_kept(spark):
    docs = frame(spark, [(1, "a", "en")])
    for keep in (["ids"], ["_text"]):
        with pytest.raises(ValueError):
            sc.encode_documents(docs, keep=keep) if keep == ["ids"] else lid.identify(docs, lid.Models([], np.zeros((1, 0))), keep=keep)
    assert sc.encode_documents(docs).columns == ["doc_id", "n_pieces", "ids", "round_trip"]


def documents():
    rng = random.Random(8)
    kinds = {"aa": ["the", "and", "with", "house", "water"], "bb": ["der", "und", "nicht", "haus", "wasser"]}
    rows = [(k, " ".join(rng.choices(w, k=rng.randint(3, 40)))) for _ in range(40) for k, w in kinds.items()]
    rows += [("aa", None), ("bb", ""), (None, "und der haus"), ("aa", "7 8"), ("aa", "x" * 300_000), ("bb", "漢字" * 60_000), ("aa", "the and"), ("aa", "the and")]
    out = [(i, t, k) for i, (k, t) in enumerate(rows)]
    return [*out, (out[3][0], out[3][1], "aa"), (None, "the water", "aa")]


def test_registered_language_query(spark, tmp_path):
    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_language_id"](spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    # the fit again from the rows that may be learned from: one round over all their words
    v = load()
    models = lid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id is null or crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 != 1"), lid.F.lit(False))
    p = models.with_none()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"]) for r in got)) == sorted((i is None, i or 0, held(i)) for i, _, _ in rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        t = texts[r["doc_id"]]
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        log = np.sum([lid.forward([w], p, v)[0][0] for w in lid.text_words(t, v)], axis=0)
        k = int(log[:-1].argmax())
        assert r["lang_pred"] == models.languages[k] and r["score"] == pytest.approx(float(np.exp(log[k] - np.logaddexp.reduce(log))), abs=1e-4)


def test_registered_codec_query(spark, tmp_path):
    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_sentencepiece"](spark, str(tmp_path)).collect()
    v, texts = load(), {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["round_trip"] and r["n_pieces"] == len(r["ids"]) and sc.decode(r["ids"], v) == t
        if len(t) < 3000:
            assert r["ids"] == [x for s in (CUTS.findall(MARK + t.replace(" ", MARK)) if t else []) for x in brute_path(s, v)]


def test_ties_go_to_the_first_language(spark):
    n = len(load().pieces)
    models = lid.Models(["aa", "bb"], np.column_stack([np.full(n, 2 / n)] * 2))
    got = lid.identify(frame(spark, [(1, "the water", "bb"), (2, "", "bb"), (3, None, None)]), models).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["aa", "und", "und"] and 0 < got[0]["score"] <= 0.5


def test_other_languages_score_low(spark):
    rows = [(i, t, k) for i, t, k in documents() if k and t]
    models = lid.fit(frame(spark, rows), lid.F.lit(False))
    got = {r["doc_id"]: r["score"] for r in lid.identify(frame(spark, [(1, "the house and the water with", None), (2, "zug bqx kjw vyf " * 20, None)]), models).collect()}
    assert got[1] > 0.9 > 0.5 > got[2]
