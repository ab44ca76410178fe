"""What surrounds a language model: embedding and completion by injected callables, JSON repair, links of citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of development-control documents by words of their titles, first match wins.
VIEWER_KEYS = [
    (["albury"], "albury-dcp"),
    (["georges river"], "georges-river-dcp"),
    (["parramatta"], "parramatta-dcp"),
    (["randwick"], "randwick-dcp"),
    (["liverpool", "schedule 1"], "liverpool-dcp-sch1"),
    (["liverpool", "schedule 2"], "liverpool-dcp-sch2"),
    (["liverpool", "schedule 3"], "liverpool-dcp-sch3"),
    (["liverpool"], "liverpool-dcp-main"),
]


def json_repair(text: Column) -> Column:
    """A model's JSON without a code fence and without what stands before its first bracket; null where that is no JSON."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    start = F.regexp_instr(bare, F.lit(r"[{\[]"))
    found = F.when(start > 0, F.substr(bare, start))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def viewer_key(title: Column) -> Column:
    low = F.lower(title)
    one = lambda words: reduce(lambda a, b: a & b, [low.contains(w) for w in words])
    return reduce(lambda rest, x: F.when(one(x[0]), x[1]).otherwise(rest), reversed(VIEWER_KEYS), F.lit(None).cast("string"))


def clause_url(doc_type: Column, source_url: Column, title: Column, local_id: Column) -> Column:
    """Plans and policies link to their source at the section, control plans to the viewer; null where neither is known."""
    viewer = F.concat(F.lit("/doc-viewer?doc="), viewer_key(title), F.lit("&anchor="), F.url_encode(local_id))
    return F.when(doc_type.isin("lep", "sepp"), F.concat(source_url, F.lit("#"), local_id)).when(doc_type == "dcp", viewer)


def embed(rows: DataFrame, column: str, call: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """(text, embedding) of a column's distinct texts by an injected callable, which gets up to `batch` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                texts = b.column(0).slice(at, batch).to_pylist()
                yield pa.record_batch([pa.array(texts, pa.string()), pa.array(call(texts), pa.list_(pa.float32()))], ["text", "embedding"])

    return rows.select(F.col(column).alias("text")).filter(F.col("text").isNotNull()).distinct().mapInArrow(run, "text string, embedding array<float>")


def hash_embedding(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedding without a model, for offline use: hashed word counts of unit length."""

    def call(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "replace"))
                v[h % size] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return call


def first_answer(providers: list[Callable[[str], str]], prompt: str) -> str:
    """The first provider's answer that is no error; the last error if all fail."""
    error: Exception = ValueError("no provider")
    for call in providers:
        try:
            return call(prompt)
        except Exception as e:  # noqa: BLE001  any failure of one provider sends the question to the next
            error = e
    raise error
