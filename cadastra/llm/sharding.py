"""Sharding by a k-d tree over metadata, in DataFrame operations alone.

A point is a document with integer coordinates taken from its text: bytes, share of characters beyond ASCII, lines. Each node
of the tree is split along the dimension that is widest in it (against its whole extent) at the weighted median: bytes are the
weight. Medians come from histograms of BINS bins, summed in Spark and refined until the bin that holds the median is light or is
a single key; the driver sees at most BINS rows a node and pass. A document's node follows from
its own coordinates and the level's few cuts, so nothing is joined and nothing but counts is shuffled.

Within a coordinate, keys go on with the text's hash, so that equal texts have one key and stay together. Only a group of copies
that weighs more than 1/PARTS of a shard gets several keys, by a hash of the doc_id, and may be cut in two; there are at most
shards * PARTS such groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import cut

BINS, PARTS, PIECES = 4096, 128, 1024
#: Rows that are numbered together, on average.
BLOCK = 100_000
#: A bin that weighs less than this share of its node is cut at its nearer end: a median is inexact by half of that at most.
LIGHT = 0.002


def coordinates(text: Column) -> dict[str, Column]:
    """Non-negative integer metadata below 2**31, each a function of the text, so that copies share them."""
    size, chars = F.octet_length(text), F.char_length(text)
    lines = chars - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    wide = F.floor((size - chars).cast("long") * 1_000_000 / F.greatest(size, F.lit(1)))
    return {"_size": size, "_wide": wide, "_lines": lines}


def _case(of: dict[int, object], node: str = "_node") -> Column:
    """A long for each node."""
    out = F
    for k, v in of.items():
        out = out.when(F.col(node) == k, F.lit(v).cast("long"))
    return out


def _medians(points: DataFrame, axis: dict[int, str], span: dict[int, tuple[int, int]], share: dict[int, float], weight: dict[int, int]) -> dict[int, int]:
    """For each node the first key of the right side, so that the left side weighs about share of the node."""
    lo, hi = {k: x[0] << 32 for k, x in span.items()}, {k: (x[1] << 32) + (1 << 32) - 1 for k, x in span.items()}
    below, out = dict.fromkeys(axis, 0), {}
    key = F
    for k, a in axis.items():
        key = key.when(F.col("_node") == k, F.col(a))
    keyed = points.withColumn("_key", key)
    while lo:
        width = {k: -(-(hi[k] - lo[k] + 1) // BINS) for k in lo}
        at = keyed.filter((F.col("_key") >= _case(lo)) & (F.col("_key") <= _case(hi))).select("_node", "_weight", (F.col("_key") - _case(lo)).alias("_off"), _case(width).alias("_width"))
        rows = at.groupBy("_node", F.expr("_off div _width").alias("_bin")).agg(F.sum("_weight").alias("w")).collect()
        for k in list(lo):
            goal, total, found = share[k] * weight[k], below[k], None
            for b, w in sorted((r["_bin"], r["w"]) for r in rows if r["_node"] == k):
                if total + w >= goal:
                    found = (b, w)
                    break
                total += w
            b, w = found or (BINS - 1, 0)
            first = lo[k] + b * width[k]
            if w <= LIGHT * weight[k] or width[k] == 1:
                out[k] = first if goal - total <= total + w - goal else first + width[k]
                del lo[k], hi[k]
            else:
                below[k], lo[k], hi[k] = total, first, min(hi[k], first + width[k] - 1)
    return out


def kd_shards(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 and the weight; shards weigh nearly the same (law `bytes`), as far as single documents
    allow. Null text counts as empty. slot numbers the rows of a shard from 0 without gaps, in the order of doc_id within hash
    blocks; rows that repeat a doc_id, or have none, get a slot each. Texts of any length are one point and one row. grown_shard is null: the law is not `key`. An empty table gives an empty
    result. Columns besides doc_id and text are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    dims = coordinates(F.col("_text"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("_text"))
    rows = rows.select("doc_id", (F.octet_length("_text") + 1).cast("long").alias("size"), F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"), F.xxhash64("_text").alias("_hash"), *[c.cast("long").alias(k) for k, c in dims.items()])
    rows = cut(rows, "shard-rows")
    whole, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    whole, blocks = whole or 0, max(1, -(-n_rows // (shards * BLOCK)))
    limit = max(1, whole // (shards * PARTS))
    # Every group here weighs more than 1/(shards * PARTS) of everything: shards * PARTS rows at most.
    heavy = rows.groupBy("_hash", "text_crc32", "size").agg(F.sum("size").alias("_w"), F.count("*").alias("_n")).filter((F.col("_w") > limit) & (F.col("_n") > 1))
    heavy = heavy.select("_hash", "text_crc32", "size", F.least(F.lit(PIECES), F.ceil(F.col("_w") / limit)).cast("long").alias("_pieces"))
    keyed = rows.join(F.broadcast(heavy), ["_hash", "text_crc32", "size"], "left")
    low = F.col("_hash").bitwiseAND(F.lit(0xFFFFFFFF))
    piece = low - low % PIECES + F.pmod(F.xxhash64("doc_id"), F.col("_pieces"))
    tail = F.when(F.col("_pieces").isNull(), low).otherwise(piece)
    points = keyed.select("doc_id", "size", "text_crc32", F.col("size").alias("_weight"), *[(F.least(F.col(d), F.lit((1 << 31) - 2)) * (1 << 32) + tail).alias(d) for d in dims])

    names = list(dims)
    leaves = {1: shards}  # how many shards each node of the level becomes; a node's children are 2k and 2k+1
    points, extent = points.withColumn("_node", F.lit(1)), None
    while whole and any(n > 1 for n in leaves.values()):
        open_ = [k for k, n in leaves.items() if n > 1]
        points = cut(points, "shard-level")
        span = points.groupBy("_node").agg(F.sum("_weight").alias("w"), *[F.array(F.min(F.shiftright(d, 32)), F.max(F.shiftright(d, 32))).alias(d) for d in names]).collect()
        extent = extent or {d: max(1, span[0][d][1] - span[0][d][0]) for d in names}
        span = {r["_node"]: r for r in span}
        open_ = [k for k in open_ if k in span]
        axis = {k: max(names, key=lambda d: (span[k][d][1] - span[k][d][0]) / extent[d]) for k in open_}
        weight = {k: span[k]["w"] for k in open_}
        found = _medians(points, axis, {k: tuple(span[k][axis[k]]) for k in open_}, {k: (leaves[k] // 2) / leaves[k] for k in open_}, weight)
        child = F.col("_node")
        for k in open_:
            child = F.when(F.col("_node") == k, 2 * k + (F.col(axis[k]) >= found[k]).cast("int")).otherwise(child)
        points = points.withColumn("_node", child.cast("int"))
        leaves = {k: 1 for k, n in leaves.items() if k not in open_} | {2 * k + i: leaves[k] // 2 + i * (leaves[k] % 2) for k in open_ for i in (0, 1)}
    # left before right at every depth: compare the paths from the root
    ends = sorted(leaves, key=lambda k: f"{k:b}")
    shard = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(ends) for x in (k, i)]), F.col("_node"))
    placed = points.withColumn("shard", shard.cast("int")).withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    # a row for each BLOCK rows of the table, and one a shard
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32")) - 1
    out = placed.select("doc_id", "size", "text_crc32", "shard", "_block").join(F.broadcast(counts), ["shard", "_block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + within).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
