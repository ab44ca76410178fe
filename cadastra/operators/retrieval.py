"""Hybrid retrieval as batch plans: exact vector search, reciprocal rank fusion with a text search, and what follows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.text import subject_normalise
from cadastra.functions.vectors import cosine
from cadastra.sources.tables import written

K_EACH, K_FUSED, K_EXPANDED, K_CONTEXT, RRF = 50, 30, 30, 60, 60


def vector_search(rows: DataFrame, vector: list[float], k: int = K_EACH, id_col: str = "id", column: str = "embedding", digits: int = 6, where: Column | None = None) -> DataFrame:
    """(id, vector_distance, vector_rank): of the rows that `where` lets through the k nearest by cosine distance, null vectors left out, ties by id."""
    rows = rows if where is None else rows.filter(where)
    q = F.array(*[F.lit(float(x)) for x in vector])
    d = F.round(1 - cosine(F.col(column), q), digits) + F.lit(0.0)
    top = rows.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), d.alias("vector_distance")).orderBy("vector_distance", "id").limit(k)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy("vector_distance", "id")))


def batch_vector_search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", column: str = "embedding", digits: int = 6, most: int = 4096) -> DataFrame:
    """(query_id, id, distance, rank) for a set of queries (query_id, vector) against all rows; null vectors are left out, ties by id.

    Queries go over the rows in blocks of about `most`, each as one matrix. A task keeps its k best for each query of the block over
    all that it reads, and the tasks' best meet in one window per query.
    """
    asked = written(queries.filter("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector"), "queries")
    n = -(-asked.count() // most)
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(n, 1))))
    source = rows.filter(F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column))

    def near(block: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in block], np.int64)
        m = np.array([r["vector"] for r in block], float)
        given = rows.sparkSession.sparkContext.broadcast(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, held, far = given.value, np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    x = np.array(part.column(1).to_pylist(), float)
                    norm = np.linalg.norm(x, axis=1)
                    d = np.round(1 - np.divide(m @ x.T, norm, out=np.zeros((len(m), len(x))), where=norm > 0), digits) + 0.0
                    far, held = np.hstack([far, d]), np.hstack([held, np.broadcast_to(part.column(0).to_numpy(), d.shape)])
                    best = np.lexsort((held, far), axis=1)[:, :k]
                    far, held = np.take_along_axis(far, best, axis=1), np.take_along_axis(held, best, axis=1)
            yield pa.record_batch([pa.array(np.repeat(ids, held.shape[1])), pa.array(held.ravel()), pa.array(far.ravel())], ["query_id", "id", "distance"])

        return source.mapInArrow(run, "query_id long, id long, distance double")

    blocks = [asked.filter(F.col("_block") == i).orderBy("query_id").collect() for i in range(n)] if n <= 1 else None
    if blocks is None:  # one block at a time in the driver's memory, each one's answers written
        found = [written(near(asked.filter(F.col("_block") == i).orderBy("query_id").collect()), "near") for i in range(n)]
    else:
        found = [near(x) for x in blocks if x]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    every = reduce(DataFrame.unionByName, found)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k)


def fuse(vector: DataFrame, text: DataFrame, k: int = K_FUSED) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; equal scores keep rows of the vector list first."""
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    both = vector.select("id", "vector_rank").join(text.select("id", "text_rank"), "id", "full")
    both = both.withColumn("rrf_score", F.round(part("vector_rank") + part("text_rank"), 9))
    return both.orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank"), "id").limit(k)


def expand(seeds: DataFrame, edges: DataFrame, most: int = K_EXPANDED) -> DataFrame:
    """(id, expanded_via, pos): neighbours of the seeds along `defines` into them, `requires` out, `constrains` into them.

    seeds: kind, key; edges: type, from_kind, from_key, to_kind, to_key; an id is the kind and the key written together. Edges meet
    the seeds on their own columns, so that what Spark knows of these prunes the scans. A neighbour counts under the first type that
    reaches it; seeds don't count. Of all, the first `most` by type, then id.
    """
    steps = [("defines", "to", "from", 1), ("requires", "from", "to", 2), ("constrains", "to", "from", 3)]
    # written, so that Spark knows how few they are and sends them to the edges instead of shuffling these
    ids, found = written(seeds.select(F.col("kind").alias("_kind"), F.col("key").alias("_key")), "seeds"), None
    for kind, near, far, order in steps:
        e = edges.filter((F.col("type") == kind) & F.col(f"{far}_key").isNotNull())
        got = e.join(ids, (e[f"{near}_kind"] == ids["_kind"]) & (e[f"{near}_key"] == ids["_key"]), "left_semi")
        got = got.select(F.col(f"{far}_kind").alias("kind"), F.col(f"{far}_key").alias("key"), F.lit(order).alias("_order"))
        found = got if found is None else found.unionByName(got)
    first = found.groupBy("kind", "key").agg(F.min("_order").alias("_order")).join(ids, (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")), "left_anti")
    kinds = F.element_at(F.array(*[F.lit(k) for k, *_ in steps]), F.col("_order"))
    top = first.select(F.concat("kind", F.col("key").cast("string")).alias("id"), "_order").orderBy("_order", "id").limit(most)
    return top.select("id", kinds.alias("expanded_via"), F.row_number().over(Window.orderBy("_order", "id")).alias("pos"))


def precedence_pairs(rows: DataFrame) -> DataFrame:
    """(winner_id, loser_id): for each row that is overridden, the row of the lowest level (then id) in another document.

    rows: id, document_id, level, type, subject. Type and normalised subject must be equal. A group's two lowest documents are enough
    to name every loser's winner, so a group of any size makes one pair a loser.
    """
    s = rows.withColumn("_subject", subject_normalise(F.col("subject"))).filter("_subject != ''")
    per_doc = s.groupBy("type", "_subject", "document_id").agg(F.min(F.struct("level", "id")).alias("_best"))
    rank = F.row_number().over(Window.partitionBy("type", "_subject").orderBy("_best"))
    best = per_doc.withColumn("_r", rank).filter("_r <= 2").groupBy("type", "_subject").agg(F.array_sort(F.collect_list(F.struct("_best", "document_id"))).alias("_two"))
    own = s.join(best, ["type", "_subject"])
    winner = F.try_element_at(F.filter("_two", lambda x: x["document_id"] != F.col("document_id")), F.lit(1))["_best"]
    return own.withColumn("_w", winner).filter(F.col("_w.level") < F.col("level")).select(F.col("_w.id").alias("winner_id"), F.col("id").alias("loser_id"))


def precedence_kept(rows: DataFrame) -> DataFrame:
    """The rows that no row of a lower level with the same type and subject overrides; a minimum per subject, no pairs."""
    s = rows.withColumn("_subject", subject_normalise(F.col("subject")))
    least = F.min("level").over(Window.partitionBy("type", "_subject"))
    return s.withColumn("_least", least).filter("_subject = '' or level = _least").drop("_subject", "_least")


def precedence_greedy(rows: DataFrame) -> DataFrame:
    """rows (query_id, pos, id, document_id, level, type, subject) with kept, as candidates are compared in order of pos.

    A candidate that is out starts no comparisons, but one that goes out while it compares goes on. Subjects also match where one
    holds the other, which is not transitive, so the order decides. A query has K_CONTEXT candidates at most (K_FUSED found
    and K_EXPANDED reached): each query is one small group.
    """

    def run(t: pa.Table) -> pa.Table:
        items = sorted(t.to_pylist(), key=lambda r: r["pos"])
        import re

        norm = [" ".join(re.sub("[^a-z0-9 ]+", " ", (r["subject"] or "").lower()).split()) for r in items]
        out: set[int] = set()
        for i, a in enumerate(items):
            if i in out:
                continue
            for j in range(i + 1, len(items)):
                b, x, y = items[j], norm[i], norm[j]
                like = x and y and (x == y or (min(len(x), len(y)) >= 6 and (x in y or y in x)))
                if j in out or not like or a["document_id"] == b["document_id"] or a["type"] != b["type"] or a["level"] == b["level"]:
                    continue
                out.add(j if a["level"] < b["level"] else i)
        return pa.Table.from_pylist([r | {"kept": k not in out} for k, r in enumerate(items)], t.schema.append(pa.field("kept", pa.bool_())))

    fields = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    return rows.groupBy("query_id").applyInArrow(run, f"{fields}, kept boolean")


def context_block(rows: DataFrame, most: int = K_CONTEXT) -> DataFrame:
    """(pos, block): candidates as text, retrieved ones by fused score, then expanded ones, `most` of them.

    rows: id, source (`retrieved` or `expanded`), rrf_score, section, doc_type, type, subject, predicate, object, numeric_value,
    numeric_comparator, numeric_unit, value_source, source_span.
    """
    order = [(F.col("source") != "retrieved").cast("int"), F.desc_nulls_last("rrf_score"), F.col("id")]
    top = rows.orderBy(*order).limit(most)
    pos = F.row_number().over(Window.orderBy(*order))
    head = F.concat(pos.cast("string"), F.lit(". ["), F.col("section"), F.lit("] ("), F.upper("doc_type"), F.lit(" · "), F.col("type"), F.lit(")"))
    value = F.concat_ws(" ", F.coalesce("numeric_comparator", F.lit("")), F.col("numeric_value").cast("string"), F.col("numeric_unit"))
    told = F.when(F.col("numeric_value").isNotNull(), F.concat(F.lit("  →  "), value)).when(F.col("value_source").isNotNull(), F.concat(F.lit("  →  defers to "), F.col("value_source"))).otherwise("")
    fact = F.concat(F.lit("   "), F.concat_ws(" ", "subject", "predicate", F.nullif("object", F.lit(""))), told)
    span = F.col("source_span")
    said = F.when(F.length(span) < 240, F.concat(F.lit('   "'), span, F.lit('"'))).when(F.length(span) >= 240, F.concat(F.lit('   "'), F.substring(span, 1, 240), F.lit('…"')))
    return top.select(pos.alias("pos"), F.concat_ws("\n", head, fact, said).alias("block"))


def overrides_block(decisions: DataFrame) -> Column:
    """A line for each override (loser_subject, loser_doc, loser_level, winner_doc, winner_level)."""
    c = F.col
    return F.concat(F.lit('  • "'), c("loser_subject"), F.lit('" from '), c("loser_doc"), F.lit(" (level "), c("loser_level"), F.lit(") overridden by "), c("winner_doc"), F.lit(" (level "), c("winner_level"), F.lit(")"))
