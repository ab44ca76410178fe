"""Approximate vector search by inverted lists: vectors lie in the list of their nearest centroid, and a search reads the lists near it.

Vectors count by direction (cosine). Centroids are fitted on a bounded sample, every vector is put into a list, lists are folders of a Parquet
table, so that a search prunes all others before it opens a file. How many lists a search reads is set when the index is made: as many
as the sample needs for the recall asked for, plus some more. With `certain`, a second pass reads the lists that may still hold something
nearer, by each list's radius, and the result is that of a full search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.sources.tables import written

#: Vectors that the centroids are fitted on, at most; lists, at most: a list has at least 16 of the sample.
SAMPLE, ROUNDS = 20_000, 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _sampled(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of id; rows that repeat an id differ by their vectors' hashes."""
    few = rows.withColumn("_h", F.xxhash64(F.lit(seed), "id", "vector")).orderBy("_h").limit(most)
    return _unit(np.array([r["vector"] for r in few.select("vector").collect()], float))


def fit_centroids(x: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Directions of `lists` groups of unit vectors; a group that runs empty takes the vector that is furthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        near = x @ c.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        c = _unit(sums)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, recall: float, k: int = 10, asked: int = 500) -> int:
    """How many lists a search has to read for this share of its k nearest, in the sample."""
    q, own = x[:asked], (x @ c.T).argmax(axis=1)
    near = np.argsort(-(q @ x.T), axis=1)[:, 1 : k + 1]
    order = np.argsort(-(q @ c.T), axis=1)
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(len(c))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(turn, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else len(c)


def _listed(centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                near = _unit(_matrix(part.column(1))) @ c.T
                own = near.argmax(axis=1)
                away = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(own)), own], 0))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(own.astype(np.int32)), pa.array(away)], ["id", "vector", "list", "away"])

    return run


def build_index(rows: DataFrame, path: str, id_col: str = "id", column: str = "embedding", recall: float = 0.95, most: int = SAMPLE, lists: int | None = None, seed: int = 1) -> None:
    """Write the index of all rows with an id and a vector to path; vectors of zeros are nearest to no list and lie in the first.

    Lists: as many as the square root of the number of rows, at most a sixteenth of the sample, which has `most` rows at most and is
    collected, as are the centroids. A list of any size is spread over files by id.
    """
    spark = rows.sparkSession
    source = rows.filter(F.col(id_col).isNotNull() & F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    x = _sampled(source, most, seed)
    if not len(x):
        raise ValueError("there is no vector to fit centroids on")
    n = lists or max(1, min(math.isqrt(source.count()), len(x) // 16))
    c = fit_centroids(x, n, seed)
    probes = min(n, math.ceil(1.1 * probes_for(x, c, recall)))
    told = source.mapInArrow(_listed(spark.sparkContext.broadcast(c)), "id long, vector array<double>, list int, away double")
    told.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/vectors")
    radius = spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    made = spark.createDataFrame([(i, v.tolist(), probes) for i, v in enumerate(c)], "list int, centroid array<double>, probes int")
    made.join(radius, "list", "left").coalesce(1).write.parquet(f"{path}/lists")


class Lists:
    """The lists of an index: centroids, radii, numbers of rows, and how many to read."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
        self.centroids = np.array([r["centroid"] for r in rows])
        self.radius = np.array([-np.inf if r["radius"] is None else r["radius"] for r in rows])
        self.sizes = np.array([r["n"] or 0 for r in rows])
        self.probes = rows[0]["probes"]
        self.path, self.spark = path, spark

    def probed(self, q: np.ndarray, probes: int | None) -> np.ndarray:
        """For each unit vector whether a list is among those that it reads."""
        out = np.zeros((len(q), len(self.centroids)), bool)
        near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : probes or self.probes]
        np.put_along_axis(out, near, True, axis=1)
        return out

    def within(self, q: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """For each unit vector whether a list may hold a vector at this cosine distance or nearer."""
        away = np.sqrt(np.maximum(2 - 2 * q @ self.centroids.T, 0))
        return away - self.radius[None, :] <= np.sqrt(2 * np.maximum(distance, 0))[:, None] + 1e-6


def _nearest(lists: Lists, ids: np.ndarray, q: np.ndarray, ask: np.ndarray, k: int, digits: int) -> DataFrame:
    """(query_id, id, distance): the tasks' k best for each query in the lists that it asks."""
    spark = lists.spark
    given = spark.sparkContext.broadcast((ids, q, ask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, ask = given.value
        far, held = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                of = part.column(2).to_numpy()
                for one in np.unique(of):
                    who = np.flatnonzero(ask[:, one])
                    some = part.filter(pa.array(of == one))
                    own = some.column(0).to_numpy()
                    for block in np.array_split(who, max(1, len(who) // 512)):
                        d = np.round(1 - q[block] @ _unit(_matrix(some.column(1))).T, digits) + 0.0
                        f, h = np.hstack([far[block], d]), np.hstack([held[block], np.broadcast_to(own, d.shape)])
                        best = np.lexsort((h, f), axis=1)[:, :k]
                        far[block], held[block] = np.take_along_axis(f, best, axis=1), np.take_along_axis(h, best, axis=1)
        row, col = np.nonzero(np.isfinite(far))
        yield pa.record_batch([pa.array(ids[row], pa.int64()), pa.array(held[row, col], pa.int64()), pa.array(far[row, col])], ["query_id", "id", "distance"])

    wanted = np.flatnonzero(ask.any(axis=0)).tolist()
    source = spark.read.parquet(f"{lists.path}/vectors").filter(F.col("list").isin(wanted)).select("id", "vector", "list")
    return source.mapInArrow(run, "query_id long, id long, distance double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return best.filter(F.col("rank") <= k)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int | None = None, certain: bool = False, digits: int = 6, most: int = 4096) -> DataFrame:
    """(query_id, id, distance, rank): for each query (query_id, vector) the k nearest in the lists that it reads; ties by id.

    probes: how many lists, if not as many as the index was made for. certain: read also the lists that may hold something nearer than
    the k-th found, which gives the k nearest of all. Queries are taken in blocks of about `most`, each in the driver's memory
    once and its answers written; null vectors are left out.
    """
    lists = Lists(spark, path)
    asked = written(queries.filter("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "vector-queries")
    blocks, out = max(1, -(-asked.count() // most)), None
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").collect()
        ids, q = np.array([r["query_id"] for r in rows], np.int64), _unit(np.array([r["vector"] for r in rows], float).reshape(len(rows), -1)) if rows else np.zeros((0, lists.centroids.shape[1]))
        ask = lists.probed(q, probes)
        found = written(_ranked(_nearest(lists, ids, q, ask, k, digits), k), "vector-found")
        if certain:
            last = {r["query_id"]: r["far"] for r in found.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(2.0).alias("far")).collect()}
            more = lists.within(q, np.array([last.get(j, 2.0) for j in ids]) + 10.0**-digits) & ~ask & (lists.sizes > 0)[None, :]
            if more.any():
                both = found.drop("rank").unionByName(_nearest(lists, ids, q, more, k, digits))
                found = written(_ranked(both, k), "vector-found")
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "id", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers (query_id, id) that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hits.agg(F.count("_hit") / F.count("*")).first()[0]


def share_read(spark: SparkSession, path: str, queries: DataFrame, probes: int | None = None) -> float:
    """The share of the index's rows that an average query of (vector) is held against; the queries are few."""
    lists = Lists(spark, path)
    q = _unit(np.array([r["vector"] for r in queries.select("vector").filter("vector IS NOT NULL").collect()], float))
    return float((lists.probed(q, probes) @ lists.sizes).mean() / max(1, lists.sizes.sum()))
