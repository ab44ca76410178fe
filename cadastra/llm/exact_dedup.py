"""Exact dedup: group by a 128-bit content hash, compare the bytes inside groups, keep one row of each class.

Only each hash's count and its best row go on to the join; texts are shuffled once, after map-side combining, so a group that
holds a third of all rows arrives as one row per map task. The join back to the documents is a plain equi-join that adaptive
execution splits where a hash is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import SPACES, cut


def squeeze(text: Column) -> Column:
    """The text without the six ASCII spaces; null gives the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest128(sha256: Column) -> Column:
    """The first 128 bits of the content's SHA-256 in hex."""
    return F.substring(sha256, 1, 32)


def exact_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = digest128
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII spaces. Of equal texts the row with the most code points in its
    original text stays, then the smallest doc_id; a null doc_id comes last. Null texts count as empty and are equal to each
    other and to texts of spaces. Texts of any length are compared whole. Rows that repeat a doc_id share its decision. An empty table gives an empty result; columns
    besides text and doc_id are not read. digest may be weakened to show that colliding hashes don't merge texts.
    """
    sha = F.sha2(F.encode("_norm", "UTF-8"), 256)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", F.char_length("_text").alias("_len"), squeeze(F.col("_text")).alias("_norm"))
    rows = rows.withColumn("text_sha256", sha).withColumn("_hash", digest(F.col("text_sha256")))

    def best(keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("_len")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))).alias("_best"))

    # The bytes are part of the grouping key: inside a hash's group they are compared, and colliding texts part.
    classes = cut(best(["_hash", "_norm"]).select("_hash", "group_size", F.col("_best.c").alias("keep_id")), "exact-classes")
    collided = classes.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash")
    thin = rows.select("doc_id", "text_sha256", "_hash")
    joined = thin.join(classes, "_hash")
    if not collided.isEmpty():
        collided = cut(collided, "exact-collided")
        apart = rows.join(collided, "_hash")
        texts = best(["_hash", "_norm"]).join(collided, "_hash").select("_hash", "_norm", "group_size", F.col("_best.c").alias("keep_id"))
        apart = apart.join(texts, ["_hash", "_norm"])
        joined = joined.join(collided, "_hash", "left_anti").unionByName(apart.select(*joined.columns))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
