"""Full-text search: an index of stems with positions as a table, and ranking by cover density.

The index is a Parquet table of (stem, id, positions), in folders by a checksum of the stem and inside these sorted by stem: a
search reads the folders of its stems, and of their files the row groups that can hold them. A search is a conjunction: documents with
all of its stems. Their score adds up over covers, the shortest stretches that hold all stems: a cover in which other words stand
between counts less.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.functions.stems import Stems, positions, search_stems, stem

BUCKETS = 64
#: What a cover of words without weights of their own counts.
WEIGHT = 0.1


def bucket(word_stem: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word_stem.encode()) % buckets


def _found(kind: str, wanted: frozenset[str] | None, buckets: int):
    schema = pa.schema([("id", pa.int64() if kind == "bigint" else pa.string()), ("stem", pa.string()), ("positions", pa.list_(pa.int32())), ("bucket", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems()
        for b in batches:
            rows, held = [], 0
            for i, text in zip(b.column(0), b.column(1), strict=True):
                told = positions(text.as_py(), stems, wanted)
                rows += [(i.as_py(), s, at, bucket(s, buckets)) for s, at in told.items()]
                held += sum(map(len, told.values()))
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def postings(rows: DataFrame, id_col: str = "id", column: str = "text", wanted: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(id, stem, positions, bucket): each document's stems (of those wanted) with the places of their words; rows without an id are left out."""
    kind = "bigint" if dict(rows.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else "string"
    source = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("id"), F.col(column).cast("string").alias("text"))
    return source.mapInArrow(_found(kind, None if wanted is None else frozenset(wanted), buckets), f"id {kind}, stem string, positions array<int>, bucket int")


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([stem(w) for w in b.column(0).to_pylist()], pa.string())], ["word", "stem"])


def with_stems(words: DataFrame) -> DataFrame:
    """Lower-cased words (word, none null) with their stems (stem); for distinct words, of which there are few beside a corpus."""
    return words.select("word").mapInArrow(_stemmed, "word string, stem string")


def add_documents(rows: DataFrame, path: str, id_col: str = "id", column: str = "text", buckets: int = BUCKETS) -> None:
    """Put documents into the index at path, which is made if it isn't there; those that it has already are left as they are.

    The index keeps the ids of its documents beside the postings, written after these: what a failed run has left without an id is written again, and
    a search takes each document's stem once. A stem of very many documents is spread over files by id.
    """
    spark = rows.sparkSession
    known = indexed(spark, path)
    new = rows.filter(F.col(id_col).isNotNull())
    if known is not None:
        new = new.join(known.select(F.col("id").alias("_known")), F.col(id_col) == F.col("_known"), "left_anti")
    found = postings(new, id_col, column, buckets=buckets)
    # a range of (folder, stem, id) for each task: few files a folder, each with a narrow range of stems
    found.repartitionByRange("bucket", "stem", "id").sortWithinPartitions("bucket", "stem", "id").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    new.select(F.col(id_col).alias("id")).write.mode("append").parquet(f"{path}/documents")


def indexed(spark: SparkSession, path: str) -> DataFrame | None:
    """The ids of the documents in the index at path, None if there is no index."""
    try:
        return spark.read.parquet(f"{path}/documents")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def cover_density(at: Column, n: int) -> Column:
    """The score of a document from its sorted array of structs (pos, k): places of the search's n stems, k from 0 on.

    A fold over the places keeps each stem's last one. The least of them begins the shortest stretch with all stems that ends here; it is a
    cover if it begins behind the last cover's begin. A cover counts WEIGHT, divided by 1 + the number of other words inside it.
    """
    none = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("rank"))
    start = F.struct(F.array_repeat(none, n).alias("last"), F.lit(-1).alias("begun"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda y, k: F.when(k == x["k"], F.struct(x["pos"].alias("pos"), acc["rank"].alias("rank"))).otherwise(y))
        # a struct holding the least, so that it is looked up once
        told = F.transform(F.array(F.struct(last.alias("last"), F.array_min(last).alias("least"))), lambda s: told_step(acc, x, s))
        return told[0]

    def told_step(acc: Column, x: Column, s: Column) -> Column:
        least = s["least"]
        noise = (x["pos"] - least["pos"]) - (acc["rank"] - least["rank"])
        cover = (least["pos"] >= 0) & (least["pos"] > acc["begun"])
        return F.struct(s["last"].alias("last"), F.when(cover, least["pos"]).otherwise(acc["begun"]).alias("begun"), (acc["rank"] + 1).alias("rank"), (acc["score"] + F.when(cover, WEIGHT / (1 + noise)).otherwise(0.0)).alias("score"))

    return F.aggregate(at, start, step, lambda acc: acc["score"])


def ranked(found: DataFrame, wanted: list[str], k: int, digits: int = 6) -> DataFrame:
    """(id, text_score, text_rank) of postings: the k documents with all wanted stems that score best; ties by id."""
    number = F.element_at(F.create_map(*[x for i, s in enumerate(wanted) for x in (F.lit(s), F.lit(i))]), F.col("stem"))
    each = found.filter(F.col("stem").isin(wanted)).select("id", "positions", number.alias("_k")).dropDuplicates(["id", "_k"])
    docs = each.groupBy("id").agg(F.collect_list(F.struct("positions", "_k")).alias("_all")).filter(F.size("_all") == len(wanted))
    at = F.array_sort(F.flatten(F.transform("_all", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("pos"), x["_k"].alias("k"))))))
    top = docs.select("id", F.round(cover_density(at, len(wanted)), digits).alias("text_score")).orderBy(F.desc("text_score"), "id").limit(k)
    return top.withColumn("text_rank", F.row_number().over(Window.orderBy(F.desc("text_score"), "id")))


def _nothing(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"id {kind}, text_score double, text_rank int")


def index_search(spark: SparkSession, path: str, text: str, keywords: tuple[str, ...] = (), k: int = 50, among: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(id, text_score, text_rank): the k best of the index at path for all words asked for (keywords if there are any, else the text).

    among: a table of ids (id) to which the search is kept. Without a word to ask for nothing is found.
    """
    wanted, table = search_stems(" ".join(keywords) or text), spark.read.parquet(f"{path}/postings")
    if not wanted:
        return _nothing(spark, dict(table.dtypes)["id"])
    found = table.filter(F.col("bucket").isin(sorted({bucket(s, buckets) for s in wanted})) & F.col("stem").isin(wanted))
    return ranked(found if among is None else found.join(among, "id", "left_semi"), wanted, k)


def text_search(rows: DataFrame, text: str, keywords: tuple[str, ...] = (), k: int = 50, id_col: str = "id", column: str = "text") -> DataFrame:
    """The same over rows without an index: one pass over their texts, from which only what is asked for goes on."""
    wanted = search_stems(" ".join(keywords) or text)
    if not wanted:
        return _nothing(rows.sparkSession, dict(rows.select(F.col(id_col).alias("id")).dtypes)["id"])
    return ranked(postings(rows, id_col, column, wanted), wanted, k)
