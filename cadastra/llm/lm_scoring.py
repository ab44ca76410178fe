"""LM scoring by stupid backoff over the corpus's own n-gram counts.

Each document becomes a row of its words' 64-bit hashes, written once. From that its distinct n-grams of every order are exploded, as
rows of a 64-bit hash, the place and the number of times. Grouped by hash they are the count table, partitioned by hash; n-grams that
only one document has are left out, since no other can know them. The table is joined to the same exploded n-grams, which gives each document
the counts that it has not brought itself; these are gathered per document and summed over its words. All steps are plain aggregates,
equi-joins and sorts; a frequent n-gram is one row for each document that has it.

n-grams are many more bytes than texts. So the count table and its join are made for a share of all hashes at a time, the sums
for a share of all documents, and each share's shuffle files go before the next one begins: every n-gram of every document is counted and
joined once, but they are not all on disk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import WordHashes, cut
from cadastra.llm.pieces import parts

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Hashes and places repeat, so that a table of them is small if its dictionary may hold all of a file's.
_SMALL = {"compression": "zstd", "parquet.dictionary.page.size": 8 << 20}
#: In so many parts the documents are summed.
_PARTS = 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hashes of the n-grams of words (as hashes), by the place of their last word; orders differ in their hashes."""
    out = [words]
    for _ in range(1, order):
        last = out[-1]
        out.append(_mixed(last[:-1] * _MUL + words[len(words) - len(last) + 1 :]) if len(last) else last)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        sizes = pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        for some in parts(sizes):
            part = b.slice(some.start, some.stop - some.start)
            words = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
            hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1]))
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(ends, hashes.view(np.int64))], ["doc_id", "words"])


def _exploded(order: int, share: int, shares: int):
    """The distinct n-grams of each row whose hash is in the share; `at` is the place of one of them times order, plus words less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for some in parts(lengths * 8):
                part = b.slice(some.start, some.stop - some.start)
                size = lengths[some].astype(np.int64)
                doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                found = []
                for k, g in enumerate(grams(part.column(1).flatten().to_numpy().view(np.uint64), order)):
                    mine = np.flatnonzero((g % np.uint64(shares) == share) & (place[len(place) - len(g) :] >= k))
                    found.append((g[mine], doc[mine + k], place[mine + k] * order + k))
                g, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.argsort(g)
                by = by[np.argsort(doc[by].astype(np.uint16) if len(size) < 1 << 16 else doc[by], kind="stable")]
                g, doc, at = g[by], doc[by], at[by]
                first = np.flatnonzero(np.append(np.ones(min(len(g), 1), bool), (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))
                n = np.diff(np.append(first, len(g)))
                yield pa.record_batch([part.column(0).take(pa.array(doc[first])), pa.array(g[first].view(np.int64)), pa.array(at[first]), pa.array(n)], ["row", "gram", "at", "n"])

    return run


def backoff(words: np.ndarray, order: int, alpha: float, total: int, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Each word's ln S; at and left: where n-grams stand that other documents have, and how often those have them."""
    every, size = grams(words, order), len(words)
    place, which = np.arange(size), at % order
    counts = np.zeros((order, size))
    for k, g in enumerate(every):
        known = g[at[which == k] // order - k]
        if len(known):
            by = np.argsort(known)
            known, often = known[by], left[which == k][by]
            found = np.minimum(np.searchsorted(known, g), len(known) - 1)
            counts[k, k:] = np.where(known[found] == g, often[found], 0)
    can = np.minimum(place + 1, order)
    out = alpha ** can.astype(float) / max(total, 1)
    for k in range(order):  # higher orders overwrite lower ones
        below = np.append(1.0, counts[k - 1])[:size] if k else np.full(size, float(total - size))
        ok = counts[k] > 0
        out[ok] = alpha ** (can[ok] - k - 1.0) * counts[k][ok] / below[ok]
    return np.log(out)


def _scored(order: int, alpha: float, total: int):
    """Rows sorted by document, one with its words and any number with known n-grams, to one row for each document."""
    names = ["doc_id", "n_words", "log_score", "mean_log_score"]

    def of(held: dict) -> tuple:
        sums = float(backoff(held["words"], order, alpha, total, np.concatenate(held["at"]), np.concatenate(held["left"])).sum())
        n = len(held["words"])
        return held["doc_id"], n, sums, sums / n if n else None

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that is being read; it may go on in the next batch
        for b in batches:
            out = []
            for row, doc_id, words, at, left in zip(b.column("row").to_pylist(), b.column("doc_id"), b.column("words"), b.column("at"), b.column("left"), strict=True):
                if held is None or held["row"] != row:
                    if held:
                        out.append(of(held))
                    held = {"row": row, "at": [np.zeros(0, np.int32)], "left": [np.zeros(0, np.int64)]}
                if words.is_valid:
                    held |= {"doc_id": doc_id.as_py(), "words": words.values.to_numpy().view(np.uint64)}
                else:
                    held["at"].append(at.values.to_numpy()), held["left"].append(left.values.to_numpy())
            if out:
                yield table(out)
        if held:
            yield table([of(held)])

    return run


@contextmanager
def _files_go(spark: SparkSession):
    """Shuffle files go as soon as what needs them is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, text: str = "text", doc_id: str = "doc_id", shares: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, log_score (the sum of its words' ln S), mean_log_score (over n_words).

    Words are runs of anything but ASCII spaces, as written. S of a word is the share of its longest known n-gram, up to `order`
    words, in that n-gram's context, times alpha for each word of context given up; an unknown word has alpha to the number
    of words of its longest n-gram, over all words. Counts are of all documents but the one scored (a repeated row is another document).
    Null and empty texts have 0 words, log_score 0 and a null mean. A null doc_id is scored as any other. An empty table gives an
    empty result; columns besides text and doc_id are not read. Texts of any length are read whole. n-grams are told apart by
    64-bit hashes. `shares` is in how many parts the n-grams are counted one after the other (12, for small tables 1); it
    changes nothing in the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with _files_go(spark):
        hashed = rows.mapInArrow(_hashed, "doc_id long, words array<long>").select(F.monotonically_increasing_id().alias("row"), "doc_id", "words")
        words = cut(hashed.select("*", _part()), "words", "part", **_SMALL)
        total = words.agg(F.sum(F.size("words"))).first()[0] or 0
        shares = shares or (12 if total > 1_000_000 else 1)
        known = reduce(DataFrame.unionByName, [cut(_known(words, order, share, shares), "known", "part", **_SMALL) for share in range(shares)])
        every, out = words.unionByName(known, allowMissingColumns=True), []
        for some in [range(_PARTS)] if shares == 1 else [[x] for x in range(_PARTS)]:
            gathered = every.filter(F.col("part").isin(*some)).drop("part").repartition("row").sortWithinPartitions("row")
            out.append(cut(gathered.mapInArrow(_scored(order, alpha, total), "doc_id long, n_words long, log_score double, mean_log_score double"), "scores"))
    return reduce(DataFrame.unionByName, out)


def _part() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(_PARTS)).cast("int").alias("part")


def _known(words: DataFrame, order: int, share: int, shares: int) -> DataFrame:
    """The n-grams of each row that others have as well, and how often those have them: (row, at, left, part), with arrays."""
    exploded = words.select("row", "words").mapInArrow(_exploded(order, share, shares), "row long, gram long, at long, n long").repartition("gram")
    # every column is asked for, so that the table and the join read one and the same shuffle
    counts = exploded.groupBy("gram").agg(F.sum("n").alias("c"), F.expr("count(row, at)").alias("docs")).filter("docs > 1").select("gram", "c")
    met = exploded.join(counts.hint("shuffle_hash"), "gram").select("row", F.col("at").cast("int").alias("at"), (F.col("c") - F.col("n")).alias("left"))
    gathered = met.repartition("row").groupBy("row").agg(F.collect_list(F.struct("at", "left")).alias("met"))
    return gathered.select("row", F.col("met.at").alias("at"), F.col("met.left").alias("left"), _part())
