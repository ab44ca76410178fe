"""Exact and near dedup against brute force, with nulls, empty texts, repeats, ties and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from cadastra.llm.common import SPACES
from cadastra.llm.components import components
from cadastra.llm.exact_dedup import exact_classes
from cadastra.llm.minhash import near_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _hash string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, None, None, None, "x") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def squeezed(t):
    return "".join(c for c in t or "" if c not in SPACES)


TEXTS = ["a b", "ab", "a  b", None, "", " \t\n\x0b\x0c\r", "ab ", "x" * 100000, "x " * 100000, "é", "é", "a\nb"]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_classes(spark, weak):
    digest = (lambda sha: F.substring(sha, 1, 1)) if weak else None
    got = exact_classes(frame(spark, TEXTS), **({"digest": digest} if weak else {})).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        group = [i for i, t in enumerate(TEXTS) if squeezed(t) == squeezed(TEXTS[r["doc_id"]])]
        best = min(group, key=lambda i: (-len(TEXTS[i] or ""), i))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(group), r["doc_id"] == best)


def test_exact_edges(spark):
    assert exact_classes(frame(spark, []).limit(0)).count() == 0
    got = exact_classes(frame(spark, ["q", "q", "q"], [None, 4, 4])).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"], r["kept"]) for r in got) == [(False, 4, True), (False, 4, True), (True, 4, False)]


def shingle_set(t):
    words = [w for w in (t or "").translate({ord(c): " " for c in SPACES}).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_texts(seed=1):
    """Families whose members differ from a base in a few words, so that links run through the base or along chains."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([4, 8, 30, 200, 600]))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 3, 12])):
            t = list(base)
            for _ in range(max(1, len(base) // 60)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
        chain = list(base)
        for _ in range(4):
            chain = chain[max(1, len(chain) // 40) :] + rng.choices(words, k=max(1, len(base) // 40))
            out.append(" ".join(chain).upper())
    return out + [None, "", "  ", "one", "ONE", "one two three four", "é É", "é é"] + ["a b c d e f"] * 5


def test_near_classes(spark):
    texts = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_near_edges(spark):
    assert near_classes(frame(spark, []).limit(0)).count() == 0
    got = near_classes(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 7, 7, 9])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, 7, False), (7, 7, True), (7, 7, True), (9, 9, True)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    comp = {}
    for u, v in edges:
        for x in (u, v):
            comp.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(comp[u], comp[v])
            if comp[u] != m or comp[v] != m:
                comp[u] = comp[v] = m
                changed = True
    assert got == comp
