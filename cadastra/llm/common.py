"""What the text operators share: reading tables, cutting lineage, words and stable random numbers."""

from __future__ import annotations

import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that WORD leaves out.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be in any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, an own one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: str | None = None, **options: str | int) -> DataFrame:
    """Write df as a table in the shared folder, in folders of the column `by`, and read it back, so that lost executors cost no recomputation. Options are the writer's."""
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def join_hot(rows: DataFrame, by: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows with the columns of `by`, which has one row for each key of rows, and in n how many rows have it. Both are written tables.

    Keys with more than one in `share` of all rows, of which there are fewer than `share`, are broadcast; only the other rows are shuffled.
    """
    total = by.agg(F.sum("n")).first()[0] or 0
    hot, cold = by.filter(F.col("n") * share > total).drop("n"), by.filter(F.col("n") * share <= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


class WordHashes(dict):
    """64-bit hashes of words (as bytes), kept up to about `most` bytes, then forgotten as a whole."""

    def __init__(self, most: int = 40_000_000):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        if self.held > self.most:
            self.clear()
            self.held = 0
        self.held += 180 + len(word)
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, held_out: Column, seed: int) -> DataFrame:
    """Up to `most` rows (doc_id, text, y) of documents that carry a label and are not held out, for fitting a classifier.

    The rows with the smallest hashes of doc_id are taken. `most` bounds what is broadcast to find them among the
    documents. A doc_id with several labels counts once, with its largest label.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("string").alias("y"))
    known = known.withColumn("_h", F.xxhash64(F.lit(seed), "_id")).orderBy("_h").limit(most).select("_id", "y")
    found = docs.join(F.broadcast(known), F.col("doc_id").cast("long") == F.col("_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "y")
    return cut(found.dropDuplicates(["doc_id"]), "sample")


def crc_rest(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id gives 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")) % n, F.lit(0))
