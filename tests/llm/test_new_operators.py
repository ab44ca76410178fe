"""Fill-in-the-middle, spelling variants and SimHash against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from cadastra.llm.fill_in_middle import fill_in_middle, restored
from cadastra.llm.queries import QUERIES
from cadastra.llm.simhash import HUBS, fingerprint, print_components, simhash_classes
from cadastra.llm.spelling import MOST, misspelt, near_pairs, variants

SCHEMA = "doc_id long, text string, n long, form string, word string, key long, print long, component_id long, output string, _text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "x", 1, 1, 1, "x", "x") for i, t in rows], SCHEMA)


EDGES = [(900, None), (901, ""), (902, " \t\n "), (None, "no id here at all"), (None, "no id here at all"), (7, "again one two three"), (7, "again one two three"), (903, "x" * 200_000), (904, "déjà vu 漢字 𝒳𝒴 " * 20_000)]


def brute_middle(i, t):
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    d, n = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest(), len(units)
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, tmp_path):
    rng = random.Random(1)
    bits = ["ab", " ", "<", "P>", "S>", ">", "<P", "<S", "<M", "\n", "é", " ", " ", "  "]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(300)] + [(i + 300, "held <M> here") for i in range(9)] + EDGES
    docs = frame(spark, rows)
    found = fill_in_middle(docs)
    got = found.select(*found.columns, restored(found["output"], found["form"]).alias("back")).collect()
    want = Counter((*brute_middle(i, t), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in got) == want and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, sentinels=("<P>", "<<", "M<"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(r["restored_sha256"] for r in QUERIES["op11_fill_in_middle"](spark, str(tmp_path)).collect()) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    of = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: of[w][0] if of[w] and n[of[w][0]] >= 2 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(of[w]), n[form[w]] if form[w] else None) for w in n}


def tuples(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_spelling_over_texts(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abé×", k=rng.randint(4, 9))) for _ in range(150)]
    rows = [(i, rng.choice([" ", ", ", "\n", "5", "_"]).join(rng.choice([str.title, str])(w) for w in rng.choices(vocabulary, k=60))) for i in range(200)] + EDGES
    rows += [(500, "chain " * 40 + "Chains " * 15 + "chainsé " * 5)]
    n = brute_words(rows)
    got = tuples(variants(misspelt(frame(spark, rows))))
    assert len(got) == len(n) and set(got) == brute_variants(n) and any(r[1] != r[2] for r in got if r[1])
    assert variants(misspelt(frame(spark, rows).limit(0))).count() == 0


def test_spelling_with_crowded_blocks(spark):
    """Words of few letters and with one long prefix or suffix: blocks of hundreds that are divided down to one position."""
    rng = random.Random(4)
    some = {"".join(rng.choices("abc", k=rng.randint(5, 7))) for _ in range(500)} | {"prefixed" + "".join(rng.choices("xyz", k=rng.randint(1, 4))) for _ in range(90)}
    some |= {"".join(rng.choices("xyz", k=rng.randint(1, 4))) + "endings" for _ in range(90)} | {"z" * k for k in range(5, 30)} | {"q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1499}
    n = {w: rng.choice([3, 3, 6, 6, 12, 40]) for w in sorted(some)}
    words = spark.createDataFrame([*n.items(), (None, 9)], "word string, n long")
    pairs = [tuple(sorted((r["u"], r["v"]))) for r in near_pairs(words.filter("word IS NOT NULL")).collect()]
    assert len(some) > 8 * MOST and len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in some for b in some if a < b and near(a, b)}
    got = tuples(variants(words))
    assert len(got) == len(n) and set(got) == brute_variants(n)
    with pytest.raises(ValueError):
        variants(words, times=1)


def brute_print(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(prints, bits=4):
    """The smallest member (of a list of distinct numbers) that each leads to."""
    comp = list(range(len(prints)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [root(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_simhash_over_texts(spark, tmp_path):
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(300)], []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([2, 4, 5, 40, 400]))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 6])):
            t = list(base)
            t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n", "  "]).join(t).upper())
    rows = list(enumerate(rows)) + [r for r in EDGES if r[0] is not None]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_simhash"](spark, str(tmp_path)).collect()
    prints = [brute_print(t) for _, t in rows]
    root = joined(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    assert Counter(tuple(r) for r in got) == Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root))
    assert len(set(root)) < len(set(prints)) and fingerprint(" \n") == 0
    # without ids
    got = simhash_classes(frame(spark, [(None, "a b"), (5, "A  B"), (None, "other words"), (None, None)])).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(None, 5), (5, 5), (None, None), (None, None)])
    assert simhash_classes(docs.limit(0)).count() == 0


def test_prints_in_crowds(spark):
    """Fingerprints that agree in two segments, far more of them than hubs, in groups that meet and don't; chains; links at the word's ends; random ones."""
    rng = random.Random(5)
    base, prints = rng.getrandbits(64), set()
    for g in range(6):
        centre = base ^ (rng.getrandbits(38) << 26)
        prints |= {centre ^ sum(1 << b for b in set(rng.choices(range(26, 64), k=rng.randint(0, 3)))) for _ in range(250)}
    at = rng.getrandbits(64)
    for _ in range(60):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(at)
    lone = [rng.getrandbits(64) for _ in range(300)]
    prints = sorted(prints | set(lone) | {x ^ (1 << 63) ^ 1 ^ (1 << 52) ^ (1 << 13) for x in lone[:20]} | {0, 15, (1 << 64) - 1})
    assert sum((x ^ base) & ((1 << 26) - 1) == 0 for x in prints) > 20 * HUBS
    for bits in (4, 2):
        got = {r["id"]: r["component"] for r in print_components(spark.createDataFrame([(signed(x),) for x in prints], "print long"), bits).collect()}
        root = joined(prints, bits)
        least = {}
        for x, r in zip(prints, root):
            least[r] = min(signed(x), least.get(r, signed(x)))
        want = {signed(x): least[r] for x, r in zip(prints, root) if Counter(root)[r] > 1}
        assert got == want
