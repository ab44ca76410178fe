"""Sharding, mixing and WARC: laws, brute force and round trips."""

import base64
import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cadastra.llm import warc
from cadastra.llm.mixing import _fold, _settle, mix, source_targets
from cadastra.llm.queries import QUERIES
from cadastra.llm.sharding import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, target double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, None, None) for i, t, s in rows], SCHEMA)


def test_kd_shards(spark):
    texts = [("word " * (1 + i * 7 % 90)) + ("é" * (i % 5)) + "\n" * (i % 3) for i in range(900)] + ["copy of one text"] * 300 + [None, "", "x" * 2000]
    rows = kd_shards(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    by = defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(16)) and len(rows) == len(texts)
    load = [sum(r["size"] for r in v) for v in by.values()]
    assert max(load) - min(load) < 0.06 * sum(load) / 16
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    places = defaultdict(set)
    for r in rows:
        places[texts[r["doc_id"]]].add(r["shard"])
    # only groups that weigh more than a 128th of a shard may be cut, and only where a cut of the tree goes through them
    cut = [t for t, s in places.items() if len(s) > 1]
    assert len(cut) <= 15 and all(sum(x == t for x in texts) * (len((t or "").encode()) + 1) > sum(load) / 2048 for t in cut)


@pytest.mark.parametrize("texts", [[], [None], ["a"] * 5, ["b"] * 40])
def test_kd_shards_edges(spark, texts):
    docs = frame(spark, [(7, t, None) for t in texts] or [(0, "", None)])
    rows = kd_shards(docs if texts else docs.limit(0), shards=5).collect()
    assert len(rows) == len(texts) and all(0 <= r["shard"] < 5 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > 3 * sizes[s] + 1e-9}
        for s in over or open_:
            out[s] = 3 * sizes[s] if over else w[s] * unit
        left -= sum(out[s] for s in over)
        open_ -= over or open_
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "C": 50, None: 7}, {"a": 5}, {"a": 0, "b": 3}, {"é": 100, "z": 1, "y": 1, "x": 1, "w": 5000}])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == brute_targets(sizes)


def test_mix(spark):
    names = ["a", "b", "c", None]
    rows = [(i, "w " * (i * 37 % 211), names[0] if i % 2 else names[i // 2 % 4]) for i in range(3000)] + [(9000, None, "a"), (9001, " ", "none"), (9002, "x " * 5000, "b")]
    got = mix(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        ratio = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and abs(r["copies"] - ratio) < 1
    assert target == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}
    # what is left over is the rounding of a small document, also beside one of 5,000 words
    assert all(abs(taken[s] - target[s]) <= 10 for s in names)
    again = {r["doc_id"]: r["taken"] for r in mix(frame(spark, rows).repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mix(frame(spark, rows).limit(0)).count() == 0


def test_mix_repeated_and_null_ids(spark):
    """A third of all rows is one row, another third has no id: all are rows of their own, in blocks of bounded size."""
    rows = [(7, "a b c d e f g", "s")] * 1500 + [(None, "w " * (i % 50 + 1), "s") for i in range(1500)] + [(i, "x " * (i % 90), "t" if i % 3 else None) for i in range(1500)]
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    same = [r["copies"] for r in got if r["doc_id"] == 7]
    assert set(same) <= {int(target["s"] / sum(len(t.split()) for _, t, s in rows if s == "s")) + k for k in (0, 1)}


def test_settled_masses_keep_expectations(spark):
    sizes, p = [900, 500, 60, 50, 40, 30, 20, 10, 9, 8, 7, 5, 3, 2, 1, 1] + [30] * 40, 0.4
    rows = [(str(k), k * 100 + i, k * 100 + i, n, 0, p * n) for k in range(1500) for i, n in enumerate(sizes)]
    got = _settle(spark.createDataFrame(rows, "source string, doc_id long, _key long, size long, base long, mass double"), 5).cache()
    assert got.count() == len(rows) and got.filter("mass > 1e-6 and abs(mass - size) > 1e-6").isEmpty()
    sums = [r["s"] for r in got.groupBy("source").agg(F.sum("mass").alias("s")).collect()]
    assert max(abs(s - p * sum(sizes)) for s in sums) <= 1
    for r in got.groupBy((F.col("doc_id") % 100).alias("i")).agg(F.avg("mass").alias("m")).collect():
        n = sizes[r["i"]]
        # the smallest ones, which make up for those before them, are rounded to the nearer end at times
        assert abs(r["m"] - p * n) < 5 * n * (p * (1 - p) / 1500) ** 0.5 + (max(1, 0.25 * n) if n < 30 else 0)


def test_registered_mix_query(spark, tmp_path):
    rows = [(i, "w " * (i * 53 % 300), f"s{i % 4}") for i in range(800)] + [(9000, None, "s1"), (9001, "  ", None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_mix_sources"](spark, str(tmp_path)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, of = brute_targets(dict(sizes)), Counter(), {i: (len((t or "").split()), s) for i, t, s in rows}
    for r in got:
        n, s = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * n
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 5 for s in sizes)


def test_expectations(spark):
    """Over many equal blocks every document keeps its expected mass, and each block its sum."""
    sizes, shares = [1, 5, 6, 40, 41, 90], [0.3, 0.5, 0.9, 0.2, 0.55, 0.7]
    rows = [(k, k * 6 + i, k * 6 + i, n, 0, p * n) for k in range(4000) for i, (n, p) in enumerate(zip(sizes, shares))]
    got = _fold(spark.createDataFrame(rows, "k int, doc_id long, _key long, size long, base long, mass double"), ["k"], 5)
    each = got.groupBy((F.col("doc_id") % 6).alias("i")).agg(F.avg("mass").alias("m"), F.count("*").alias("n")).collect()
    for r in each:
        n, p = sizes[r["i"]], shares[r["i"]]
        assert r["n"] == 4000 and abs(r["m"] - p * n) < 5 * n * (p * (1 - p) / 4000) ** 0.5
    total = sum(p * n for n, p in zip(sizes, shares))
    assert got.groupBy("k").agg(F.sum("mass").alias("s"), F.count_if(~F.col("done")).alias("open")).filter(f"abs(s - {total}) > 1e-6 or open != 1").isEmpty()
    assert got.filter("done and mass > 1e-9 and abs(mass - size) > 1e-9").isEmpty()


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


PAGES = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é漢\U0001f600" * 30000), (7, "u", "\r\n\r\n0\r\n\r\n" * 9000), (8, "u", "WARC/1.1\r\n\r\n"), (9, "u", "twice"), (9, "u", "twice"), (10, "u", "z" * 70000), (10, "u", "z" * 70000)]


def test_warc(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = sorted(warc.warc_pages(df).collect(), key=lambda r: r["page_id"])
    top = {}
    for i, _, h in PAGES:
        top[digest(h)] = max(i, top.get(digest(h), 0))
    want = [(i, len((h or "").encode()), digest(h), "response" if top[digest(h)] == i else "revisit", None if top[digest(h)] == i else top[digest(h)]) for i, _, h in PAGES]
    assert [tuple(r) for r in got] == want
    # with a least size short payloads are all responses
    short = warc.warc_pages(df.filter("page_id < 6"), least=10).collect()
    assert {r["record_type"] for r in short} == {"response"} and len(short) == 5
    assert warc.warc_pages(df.limit(0)).count() == 0
    none = warc.warc_pages(spark.createDataFrame([(None, "u", "q"), (None, "u", "r"), (3, "u", "r")], "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in none) == [(0, "response", 0), (0, "revisit", 3), (3, "response", 0)]


def test_framing():
    for data in (b"", b"a", "é漢".encode() * 9999):
        assert warc.dechunked(warc.chunked(data, 100)) == data
        assert b"".join(warc.pieces(data, 7)) == data and all(x[0] & 0xC0 != 0x80 for x in warc.pieces(data, 7))
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    records = list(warc.page_records(1, "u", b"x" * 500, None, segment=200))
    whole = b"".join(r + b"\r\n\r\n" for r in records)
    parsed = list(warc.parse(whole))
    assert [p[4] for p in parsed] == list(range(1, len(records) + 1)) and {p[3] for p in parsed} == {parsed[0][1]} and parsed[-1][5] == sum(len(p[8]) for p in parsed)
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-10]))


def test_foreign_archives(spark, tmp_path):
    """A gzip member a record, plain files, heads without spaces, bodies without chunks, no page numbers, other digests, records of other kinds."""
    pages = [(1, b"<html>one</html>"), (2, b"two" * 20_000), (3, b"")]
    own = [b"".join(x + b"\r\n\r\n" for x in warc.page_records(k, "http://a/", body, None)) for k, body in pages]
    made = lambda kind, more, block: b"WARC/1.0\r\nWARC-Type:" + kind + b"\r\nWARC-Record-ID:<urn:" + str(len(block)).encode() + b">\r\n" + more + b"Content-Length:%d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    plain = made(b"response", b"WARC-Payload-Digest: sha256:00\r\n", b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nplain body")
    other = made(b"warcinfo", b"", b"software: x") + made(b"response", b"", b"no head at all") + made(b"revisit", b"WARC-Refers-To: <urn:gone>\r\n", b"")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in [*own, plain]))
    (tmp_path / "b.warc").write_bytes(other)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    want = [(k, len(body), warc.base32_sha1(body), "response") for k, body in pages] + [(None, len(b), warc.base32_sha1(b), "response") for b in (b"plain body", b"no head at all")] + [(None, None, None, "revisit")]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in got) == Counter(want)
    whole = b"".join(map(gzip.compress, own))
    assert warc.unpacked(whole, 10) == warc.unpacked(whole) == b"".join(own)
    for cut in (whole[:-4], whole[: len(whole) // 2]):
        with pytest.raises(ValueError):
            warc.unpacked(cut)
