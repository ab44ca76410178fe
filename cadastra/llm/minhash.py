"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

One pass turns each text into its set of word shingles and that into BINS minima of one hash (the top bits choose the bin). An
empty bin takes the value of the first filled bin in a random order of its own, so that short texts collide as often as their
similarity says. ROWS neighbouring bins make a band, or fewer where the least similarity asks for it (band_rows); documents that
agree in a band share its bucket. Documents with equal sets are one representative from here on, however many they are.

A bucket is compared as a star: its members with one hub, the member that meets the most others over all buckets. Links are
confirmed on the full sets and give components. Buckets whose members are not yet in one component get further hubs, more in
each round, against the members of other components that they have not been compared with, until none is left: pairs
stay near the number of members where a bucket is one group, and no link between bucket mates is lost.

Shingles that only one candidate has can't be in an intersection. Two documents with n shingles each, c of them shared with anyone,
have at most min(c) in common, and so in each of CLASSES hash classes of shingles, which bounds their similarity exactly.
Members that no mate's bound lets link leave their buckets before the first star, and pairs below the bound are not made:
variants of one text that are too far apart stay cheap.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import WordHashes, cut, uniform
from cadastra.llm.components import components
from cadastra.llm.pieces import parts

BINS, ROWS, WORDS, CLASSES, SALTED = 256, 8, 5, 64, 512
#: The share of links at the least similarity that may have no band in common.
MISSED = 1 / 25_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20)
#: _ORDER[i, j]: where bin j stands in the order in which an empty bin i looks for a value.
_ORDER = np.argsort(_random.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
_COEF = _random.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_SALT = _random.integers(1, 1 << 63, BINS, dtype=np.uint64)
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_rows(percent: int) -> int:
    """The most bins a band, ROWS at most, with which links at this similarity are missed no more often than MISSED."""
    return next((r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED), 1)


def shingles(text: str | None, known: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's WORDS-word shingles.

    bytes.lower() and bytes.split() touch A-Z and the six ASCII spaces only, as the definition of a word asks.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        n = min(1, len(h))
        h = np.concatenate([h, np.full(WORDS - len(h), len(h), np.uint64)]) if n else h
    s = np.zeros(n, np.uint64)
    for k in range(WORDS if n else 0):
        s = s * _MUL + h[k : k + n]
    return np.unique(_mixed(s))


def signature(s: np.ndarray) -> np.ndarray:
    """The BINS minima of a non-empty sorted set."""
    start = np.searchsorted(s, _EDGES)
    full = start < np.append(start[1:], len(s))
    out = np.zeros(BINS, np.uint64)
    out[full] = s[start[full]]
    have, lack = np.flatnonzero(full), np.flatnonzero(~full)
    if len(lack):
        out[lack] = out[have[_ORDER[np.ix_(lack, have)].argmin(axis=1)]]
    return out


def _signed(rows: int):
    bands = BINS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for some in parts(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)):
                part = b.slice(some.start, some.stop - some.start)
                sets = [shingles(x.as_py(), known) for x in part.column(1)]
                sigs = np.stack([signature(s) if len(s) else np.zeros(BINS, np.uint64) for s in sets])
                keys = _mixed((sigs[:, : bands * rows].reshape(-1, bands, rows) * _COEF[:rows]).sum(axis=2, dtype=np.uint64) + _SALT[:bands]).view(np.int64)
                # documents without shingles have no bands
                some = np.array([len(s) > 0 for s in sets], bool)
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), lists], ["doc_id", "n_shingles", "set", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        for some in parts(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)):
            part = b.slice(some.start, some.stop - some.start)
            yield pa.record_batch([part.column(0), pa.array([shingles(x.as_py(), known).tobytes() for x in part.column(1)], pa.binary())], ["id", "shingles"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle; 32 bits will do, since two that fall together only loosen the bound."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.column(1)]
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).astype(np.uint32).view(np.int32))], ["id", "h"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, shingles and those that it has alone (folded) to id, size, and how many it shares in all and in each class."""
    for b in batches:
        rows = []
        for x, alone in zip(b.column(1), b.column(2), strict=True):
            every = np.frombuffer(x.as_py(), np.uint64).astype(np.uint32)
            own = np.zeros(0, np.uint32) if alone.values is None else alone.values.to_numpy().view(np.uint32)
            count = np.bincount(every % CLASSES, minlength=CLASSES) - np.bincount(own % CLASSES, minlength=CLASSES)
            rows.append((len(every), int(count.sum()), count))
        hist = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * CLASSES, pa.int32()), pa.array(np.concatenate([r[2] for r in rows] or [np.zeros(0)]).astype(np.int32)))
        yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), hist], ["rep", "size", "common", "classes"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    return run


def near_classes(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| for their sets of distinct WORDS-word shingles (lower-cased
    A-Z; a shorter text is one shingle). component_id is the smallest doc_id that links lead to, the document's own where none
    do; kept is doc_id = component_id. Texts of any length are read whole. Null and empty texts and texts of spaces have no shingles and no links. Rows that repeat
    a doc_id are one document; a null doc_id with shingles takes part through copies only. An empty table gives an
    empty result; columns besides text and doc_id are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = cut(rows.mapInArrow(_signed(band_rows(percent)), "doc_id long, n_shingles long, set binary, bands array<long>"), "minhash-signed")
    full = signed.filter("n_shingles > 0")
    reps = full.groupBy("set").agg(F.min("doc_id").alias("rep"))
    # the row that stands for a set; rows that repeat its doc_id say the same
    members = full.withColumnRenamed("doc_id", "rep").join(reps, ["set", "rep"]).select("rep", F.explode("bands").alias("key"))
    counts = members.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    counts = cut(counts.filter("lo < hi").select("key", "n"), "minhash-buckets")
    shared = members.join(counts, "key").groupBy("key", "rep").agg(F.max("n").alias("n"))
    shared = cut(shared, "minhash-members")
    reach = shared.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("reach"))
    # what meets in a bucket meets in one of its salts: one for each SALTED members
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    shared = cut(shared.join(reach, "rep").select("key", "rep", "reach", salts.alias("salts"), F.pmod(F.xxhash64("rep"), salts).cast("int").alias("salt")), "minhash-reach")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    ids = cut(shared.select(F.col("rep").alias("_id")).distinct(), "minhash-ids")
    sets = cut(rows.join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "text").mapInArrow(_sets, "id long, shingles binary"), "minhash-sets")

    alone = sets.mapInArrow(_folded, "id long, h int").groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("_id"))
    alone = alone.filter("n = 1").groupBy("_id").agg(F.collect_list("h").alias("alone"))
    bound = sets.join(alone, F.col("id") == F.col("_id"), "left").select("id", "shingles", "alone")
    bound = cut(bound.mapInArrow(_shared, "rep long, size long, common long, classes array<int>").dropDuplicates(["rep"]), "minhash-bound")

    def may(a: str, b: str, most: Column | None = None) -> Column:
        """Whether two documents' bounds let them link."""
        most = F.least(F.col(f"{a}common"), F.col(f"{b}common")) if most is None else most
        return 100 * most >= percent * (F.col(f"{a}size") + F.col(f"{b}size") - most)

    # Sizes further apart than 100 to percent can't link: a member is held against the best of its own size class and of the next ones.
    step = max(math.log(100 / percent) * (1 + 1e-9), 1e-12)
    shared = shared.join(bound, "rep").withColumn("_class", F.floor(F.log("size") / step))
    best = shared.groupBy("key", "salts", "_class").agg(F.struct(F.col("_class").alias("of"), F.max("common").alias("common"), F.min("size").alias("size"), F.count("*").alias("n")).alias("best"))
    best = best.withColumn("_class", F.explode(F.array(F.col("_class") - 1, F.col("_class"), F.col("_class") + 1)))
    best = salted(best.groupBy("key", "salts", "_class").agg(F.collect_list("best").alias("_near")))  # three at most

    def met(b: Column) -> Column:
        most = F.least("common", b["common"])
        return (100 * most >= percent * (F.col("size") + b["size"] - most)) & ((b["of"] != F.col("_class")) | (b["n"] > 1))

    live = shared.join(best, ["key", "salt", "_class"]).filter(F.exists("_near", met)).select("key", "rep", "reach", "salts", "salt", "size", "common", "classes")
    # The order in which a bucket's members are hubs: the one that meets the most others, then by chance, spread over 0 to n.
    lead = live.groupBy("key", "salts").agg(F.count("*").alias("_n"), F.min(F.struct(-F.col("reach"), F.col("rep")))["rep"].alias("_lead")).filter("_n > 1")
    turn = F.when(F.col("rep") == F.col("_lead"), F.lit(-1.0)).otherwise(uniform(F.col("rep"), F.col("key"), seed=3) * F.col("_n"))
    shared = cut(live.join(salted(lead), ["key", "salt"]).select("key", "rep", "salts", "salt", "size", "common", "classes", turn.alias("turn")), "minhash-live")

    def confirm(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("y")), sets.select(F.col("id").alias("u"), F.col("shingles").alias("x"))
        return pairs.join(a, "v").join(b, "u").select("u", "v", "x", "y").mapInArrow(_linked(percent), "u long, v long")

    in_classes = F.aggregate(F.zip_with("classes", "hub_classes", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x).cast("long")
    label, tested, served, hubs = None, None, -2.0, 0
    while True:
        at = shared.filter(F.col("turn") >= served)
        if label is None:
            at = at.withColumn("label", F.col("rep"))
        else:
            at = at.join(label, F.col("rep") == F.col("id"), "left").select(*shared.columns, F.coalesce("component", "rep").alias("label"))
            # of a bucket only what is open goes on: members of more than one component that have not been hubs
            open_ = at.groupBy("key", "salts").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "salts")
            at = cut(at.join(salted(open_), ["key", "salt"]), "minhash-open")
            if at.isEmpty():
                break
        star = at.filter(F.col("turn") < hubs).select("key", "salts", *[F.col(c).alias(f"hub_{c}") for c in ("rep", "label", "size", "common", "classes")])
        pairs = at.join(salted(star), ["key", "salt"]).filter((F.col("rep") != F.col("hub_rep")) & (F.col("label") != F.col("hub_label")) & may("", "hub_") & may("", "hub_", in_classes))
        pairs = pairs.select(F.greatest("rep", "hub_rep").alias("u"), F.least("rep", "hub_rep").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = cut(pairs, "minhash-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = cut(confirm(pairs), "minhash-links")
        if label is None:
            label = cut(components(found), "minhash-labels")
        elif not found.isEmpty():
            # what is new joins whole components
            side = lambda c: F.coalesce(F.col(f"{c}.component"), F.col(f"f.{c}"))
            both = found.alias("f").join(label.alias("u"), F.col("f.u") == F.col("u.id"), "left").join(label.alias("v"), F.col("f.v") == F.col("v.id"), "left")
            new = cut(components(both.select(side("u").alias("u"), side("v").alias("v"))), "minhash-merged").select(F.col("id").alias("_id"), F.col("component").alias("_to"))
            old = label.join(new, F.col("component") == F.col("_id"), "left").select("id", F.coalesce("_to", "component").alias("component"))
            label = cut(old.unionByName(new.select(F.col("_id").alias("id"), F.col("_to").alias("component")).join(label.select("id"), "id", "left_anti")), "minhash-labels")
        # hubs have met all that they had to meet; the rest of the bucket goes on without them
        served, hubs = float(hubs), max(32, hubs * 32)

    classes = reps.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set").join(cut(classes, "minhash-classes"), "set", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
