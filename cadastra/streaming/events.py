"""Event streams: encoding, framing, folding; page views; logs of interactions. Batch and streaming share the transformations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types of a run's events.
EVENT_TYPES = ["start", "plan", "retrieved", "expanded", "filtered", "answer_chunk", "answer", "citations", "done", "error"]


def encode(event: Column, data: Column) -> Column:
    """A block of a server-sent event; data is JSON text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def known_events(events: DataFrame) -> DataFrame:
    """The rows of events whose event is one of a run's types."""
    return events.filter(F.col("event").isin(EVENT_TYPES))


def decode(block: Column) -> Column:
    """struct(event, data) of a block without its blank line; the event is `message` and data empty where they are missing."""
    lines = F.split(block, "\n")
    last = lambda p, n: F.trim(F.substr(F.try_element_at(F.filter(lines, lambda x: x.startswith(p)), F.lit(-1)), F.lit(n)))
    return F.struct(F.coalesce(last("event: ", 8), F.lit("message")).alias("event"), F.coalesce(last("data: ", 7), F.lit("")).alias("data"))


def parse_runs(chunks: DataFrame) -> DataFrame:
    """(run_id, pos, event, data) of streams given as chunks (run_id, seq, chunk), which may be cut anywhere; an open tail is no event."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    blocks = F.split(F.col("s"), "\n\n")
    closed = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    at = chunks.groupBy("run_id").agg(whole.alias("s")).select("run_id", F.posexplode(closed).alias("pos", "block"))
    return at.select("run_id", F.col("pos").cast("long").alias("pos"), decode(F.col("block")).alias("e")).select("run_id", "pos", "e.*")


def token_text(chunks: DataFrame) -> DataFrame:
    """(run_id, text) of a model's token streams given as chunks (run_id, seq, chunk), cut anywhere: the contents of all deltas in order.

    Lines `data: ` hold JSON; `[DONE]`, other lines, broken JSON and an open last line say nothing.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    lines = F.split(F.col("s"), "\n")
    closed = F.filter(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: x.startswith("data: "))
    said = F.transform(closed, lambda x: F.get_json_object(F.substr(x, F.lit(7)), "$.choices[0].delta.content"))
    return chunks.groupBy("run_id").agg(whole.alias("s")).select("run_id", F.array_join(F.filter(said, lambda x: x.isNotNull()), "").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """(run_id, plan, answer, error) of events (run_id, seq, event, data): the last plan and error, and the answer's chunks in order."""
    last = lambda kind: F.max_by(F.when(F.col("event") == kind, F.col("data")), F.when(F.col("event") == kind, F.col("seq")))
    chunks = F.array_sort(F.collect_list(F.when(F.col("event") == "answer_chunk", F.struct("seq", "data"))))
    return events.groupBy("run_id").agg(last("plan").alias("plan"), F.array_join(F.transform(chunks, lambda x: x["data"]), "").alias("answer"), last("error").alias("error"))


def chunk_text(text: Column, size: int = 30) -> Column:
    """A text in pieces of `size` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def page_views(views: DataFrame, watermark: str | None = None) -> DataFrame:
    """Views per path, each session and path counted once. Streams give a watermark and a timestamp column ts."""
    if watermark:
        once = views.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "path"])
    else:
        once = views.dropDuplicates(["session_id", "path"])
    return once.groupBy("path").agg(F.count("*").alias("views"))


def latest(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last non-null value of each field for each key in the order of the log."""
    at = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def tail_parser():
    """A stateful function for groupBy(run_id).applyInPandasWithState over chunks (run_id, seq, chunk): closed blocks go out, the open tail is kept."""

    def run(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        tail = state.get[0] if state.exists else ""
        rows = []
        for b in batches:
            for chunk in b.sort_values("seq")["chunk"]:
                *closed, tail = (tail + chunk).split("\n\n")
                for block in closed:
                    found = {"event": "message", "data": ""}
                    for line in block.split("\n"):
                        name, _, value = line.partition(": ")
                        if name in found:
                            found[name] = value.strip()
                    rows.append((key[0], found["event"], found["data"]))
        state.update((tail,))
        yield pd.DataFrame(rows, columns=["run_id", "event", "data"])

    return run


def parse_stream(chunks: DataFrame) -> DataFrame:
    """The streaming form of parse_runs."""
    return chunks.groupBy("run_id").applyInPandasWithState(tail_parser(), "run_id string, event string, data string", "tail string", "append", "NoTimeout")
