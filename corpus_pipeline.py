"""A training corpus from documents: language ID, exact dedup, near-dedup, mixing of sources, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. A row is a row whatever its doc_id: rows that
share one or have none are judged by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import crc_rest, cut
from cadastra.llm.exact_dedup import exact_classes
from cadastra.llm.language_id import UNKNOWN, fit, identify
from cadastra.llm.minhash import near_classes
from cadastra.llm.mixing import mix
from cadastra.llm.sentencepiece_codec import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less probable than this among the learned ones and none of them is rejected.
LEAST = 0.5
#: Documents that share so many percent of their five-word shingles are near-duplicates.
NEAR = 80


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents with _id: a number that each row has alone, in the order of doc_id.

    Where every row has a doc_id of its own, that is it. Else the rows are sorted by doc_id (null last), then content, and written with
    their places; repeated rows are spread over the sort's partitions by their places in the files.
    """
    docs = docs.select(*COLUMNS)
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs.withColumn("_id", F.col("doc_id").cast("long"))
    content = F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))])
    keyed = docs.withColumn("_hash", content).withColumn("_place", F.monotonically_increasing_id())
    rows = keyed.orderBy(F.asc_nulls_last("doc_id"), "_hash", "_place").select(*COLUMNS, F.monotonically_increasing_id().alias("_id"))
    return cut(rows, "numbered")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the _ids in dropped; these are written first, so that Spark broadcasts them only where it knows them to be small."""
    return docs.join(cut(dropped.select(F.col("doc_id").alias("_id")), "dropped"), "_id", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without a letter and texts that no language claims go."""
    models = fit(docs, crc_rest(F.col("doc_id"), 3) == 1)
    found = identify(docs, models, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST)).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts: the longest original, then the smallest doc_id."""
    docs = _numbered(docs)
    return _without(docs, exact_classes(docs, doc_id="_id").filter("not kept"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, that with the smallest doc_id (rows without one come last)."""
    docs = _numbered(docs)
    return _without(docs, near_classes(docs, percent=NEAR, doc_id="_id").filter("not kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, from not at all to three times."""
    docs = _numbered(docs)
    copies = mix(docs, doc_id="_id").filter("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    taken = docs.join(copies, "_id")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids; rows whose ids did not give the text back would show round_trip false."""
    return encode_documents(docs, keep=COLUMNS)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]
#: SQL can't express the learned language models and the pivotal rounding; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
