"""SimHash near-dedup: fingerprints of word shingles, linked where few bits differ, found by chains of segments of a ring.

A fingerprint's 64 bits are a ring of SEGMENTS. If two differ in BITS bits at most, then some segment starts a chain in which the
first l segments together differ in at most l * BITS / SEGMENTS bits, for each l. With 4 bits and 5 segments these budgets are 0, 1, 2, 3
and 4: the first segment is equal, and the second differs in one bit at most. Both together are the key on which fingerprints meet: each
lies at its own five keys, and asks at these and at those with one bit of the second segment set that it hasn't set. The
budgets of the longer chains prune what meets, then all bits are compared, inside the join.

Documents with one fingerprint are one from here on. In each key up to HUBS fingerprints are held against all that ask there, which is all of
them nearly everywhere. Where there are more, the next ones follow in rounds, against those that aren't in their
component yet, until none is left: dense groups of near copies stay near the number of their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut, join_hot, uniform
from cadastra.llm.components import components
from cadastra.llm.pieces import parts

WORDS, SEED, BITS, SEGMENTS = 4, 42, 4, 5
#: Fingerprints of a key that all others meet at once, and askers of a key in one salt.
HUBS, SALTED = 32, 4096
#: Where the segments start; the last one ends with the 64 bits.
_STARTS = (0, 13, 26, 39, 52, 64)
_WIDTHS = [b - a for a, b in zip(_STARTS, _STARTS[1:])]
_MANY = 1 << 15


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text: a bit is 1 if set in over half of the hashes of its shingles, repeats counted.

    bytes.lower() and bytes.split() touch A-Z and the six ASCII spaces only, as the definition of a word asks.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > WORDS:
        starts, ends = starts[: 1 - WORDS], ends[WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _MANY):
        some = zip(starts[at : at + _MANY].tolist(), ends[at : at + _MANY].tolist())
        h = np.array([hashed(joined[a:b], SEED) for a, b in some], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for some in parts(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)):
            part = b.slice(some.start, some.stop - some.start)
            prints = np.array([fingerprint(x.as_py()) for x in part.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([part.column(0), pa.array(prints)], ["doc_id", "print"])


def _segment(of: Column, k: int) -> Column:
    return F.shiftrightunsigned(of, _STARTS[k]).bitwiseAND(F.lit((1 << _WIDTHS[k]) - 1))


def _mask(start: int, n: int) -> int:
    """The bits of n segments of the ring from a first one on, as a signed number."""
    bits = sum(((1 << _WIDTHS[k % SEGMENTS]) - 1) << _STARTS[k % SEGMENTS] for k in range(start, start + n))
    return bits - (1 << 64) if bits >> 63 else bits


def _keys(prints: DataFrame) -> DataFrame:
    """A row for each fingerprint and segment: print, at (the segment), key (the segment and the next)."""
    # three bits of a number tell the segment, the rest its two values
    pair = lambda k: F.lit(k << 26).bitwiseOR(F.shiftleft(_segment(F.col("print"), k), 13)).bitwiseOR(_segment(F.col("print"), (k + 1) % SEGMENTS))
    return prints.select("print", F.posexplode(F.array(*map(pair, range(SEGMENTS)))).alias("at", "key"))


def _flips(at: Column) -> Column:
    """The single bits of the segment after this one."""
    return F.element_at(F.array(*[F.array(*[F.lit(1 << b).cast("long") for b in range(_WIDTHS[(k + 1) % SEGMENTS])]) for k in range(SEGMENTS)]), at + 1)


def _asked(keys: DataFrame) -> DataFrame:
    """A row for each key at which a fingerprint asks. Of two that differ in one bit there, the one without it asks the other."""
    unset = F.filter(_flips(F.col("at")), lambda b: F.col("key").bitwiseAND(b) == 0)
    more = F.transform(unset, lambda b: F.col("key").bitwiseOR(b))
    return keys.select("print", "at", F.explode(F.concat(F.array("key"), more)).alias("key"))


def _near(u: Column, v: Column, at: Column, bits: int) -> Column:
    """Whether two fingerprints keep to the budgets of the longer chains, then to that of all bits."""
    differ = u.bitwiseXOR(v)
    chain = lambda n: F.bit_count(differ.bitwiseAND(F.element_at(F.array(*[F.lit(_mask(k, n)) for k in range(SEGMENTS)]), at + 1))) <= n * BITS // SEGMENTS
    return (u != v) & chain(3) & chain(4) & (F.bit_count(differ) <= bits)


def print_components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct fingerprints (print) to (id, component) for those with links: component is the smallest one reachable, as a signed number."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"the segments find up to {BITS} differing bits")
    keys = cut(_keys(prints), "simhash-keys")
    crowds = cut(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HUBS), "simhash-crowds")
    # the fingerprints of a crowd ask at its key and at those that a bit more gives: a salt for each SALTED of them
    around = crowds.select(F.shiftright("key", 26).cast("int").alias("at"), "key", "n")
    around = around.select("n", F.explode(F.concat(F.array("key"), F.transform(_flips(F.col("at")), lambda b: F.col("key").bitwiseOR(b)))).alias("key"))
    salts = around.groupBy("key").agg(F.ceil(F.sum("n") / SALTED).cast("int").alias("salts")).filter("salts > 1")
    salts = cut(salts, "simhash-salts")

    def lying(some: DataFrame) -> DataFrame:
        """Fingerprints at their own keys, once for each salt."""
        some = some.join(salts, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        return some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def asking(some: DataFrame) -> DataFrame:
        some = some.join(salts, "key", "left")
        return some.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("print"), "salts").cast("int"), F.lit(0))).drop("salts")

    # a crowd's members are hubs in an order of chance, spread over 0 to n
    turn = F.coalesce(uniform(F.col("print"), F.col("key"), seed=5) * F.col("n"), F.lit(0.0))
    placed = keys.join(crowds, "key", "left").select("print", "key", turn.alias("turn"))
    hubs = lying(placed.filter(F.col("turn") < HUBS).select("key", F.col("print").alias("hub")))
    found = asking(_asked(keys)).join(hubs, ["key", "salt"]).filter(_near(F.col("print"), F.col("hub"), F.col("at"), bits))
    links = cut(found.select(F.col("print").alias("u"), F.col("hub").alias("v")), "simhash-links")
    served = HUBS
    while True:
        label = cut(components(links), "simhash-labels")
        crowds = crowds.filter(F.col("n") > served)
        if crowds.isEmpty():
            return label
        labelled = lambda df: df.join(label.withColumnRenamed("id", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
        ask = cut(labelled(_asked(keys).join(crowds.select("key"), "key")), "simhash-asking")
        crowds = cut(crowds.join(ask.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "key"), "simhash-open")
        if crowds.isEmpty():
            return label
        turns = placed.filter((F.col("turn") >= served) & (F.col("turn") < served * 32)).join(crowds.select("key"), "key")
        hubs = lying(labelled(turns).select("key", F.col("print").alias("hub"), F.col("component").alias("of")))
        found = asking(ask).join(hubs, ["key", "salt"]).filter((F.col("component") != F.col("of")) & _near(F.col("print"), F.col("hub"), F.col("at"), bits))
        links = cut(links.unionByName(found.select(F.col("print").alias("u"), F.col("hub").alias("v"))), "simhash-links")
        served *= 32


def simhash_classes(docs: DataFrame, bits: int = BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Documents are linked where their fingerprints differ in `bits` bits or fewer (4 at most); component_id is the smallest doc_id that links
    lead to, the document's own where none do. Texts are read whole, of any length; fewer than four words are one shingle; null and empty texts and texts of
    spaces have the fingerprint zero, which links like any other. Rows that repeat an id or a text take part each, a row without an id
    through its fingerprint; where no row of a component has an id, component_id is null. Ties don't arise: links have no order.
    An empty table gives an empty result; columns besides text and doc_id are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    printed = cut(rows.mapInArrow(_printed, "doc_id long, print long"), "simhash-printed")
    prints = cut(printed.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "simhash-prints")
    label = print_components(prints.select("print"), bits)
    of = prints.join(label.withColumnRenamed("id", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    of = cut(of, "simhash-of")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    found = cut(of.select("print", "n", "component").join(least, "component").select("print", "n", "component_id"), "simhash-classes")
    return join_hot(printed, found, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
