"""Streams with state that ends: input that has come to rest, tokens of answers, and questions with their answers.

Each is one stateful processor by key, with timers in event time and a time to live: what stays open is handed out when the watermark passes, and what a key
has left behind goes. State is in the checkpoint, so that a stream goes on where it was after a restart. The state store has to be RocksDB
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


class Debounce(StatefulProcessor):
    """The last value of a key once nothing has come for some time."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "value string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("at", kind="stable")
        told, held = [], self.last.get() if self.last.exists() else None
        for value, at in zip(every["value"], every["at"].map(_millis)):
            if held and at < held[1]:
                continue  # a latecomer behind what is held
            if held and at - held[1] >= self.quiet:
                told.append((key[0], held[0], pd.Timestamp(held[1], unit="ms")))
            held = (value, at)
        self.last.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[1] + self.quiet)
        yield pd.DataFrame(told, columns=["key", "value", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, at = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], value, pd.Timestamp(at, unit="ms"))], columns=["key", "value", "at"])

    def close(self) -> None:
        pass


def debounced(inputs: DataFrame, quiet: int = 250, late: str = "0 seconds") -> DataFrame:
    """Inputs (key, value, at) to those after which nothing of their key came for `quiet` milliseconds, with the time of the input."""
    keyed = inputs.select("key", "value", "at").withWatermark("at", late).groupBy("key")
    return keyed.transformWithStateInPandas(Debounce(quiet), "key string, value string, at timestamp", "append", "EventTime")


def tokens_of(lines: list[str]) -> list[str]:
    """The pieces of an answer in the lines of a model's stream: `data: ` with JSON; other lines, the end mark and what can't be read say nothing."""
    out = []
    for line in lines:
        if line.startswith("data: ") and line[6:].strip() != "[DONE]":
            try:
                piece = json.loads(line[6:])["choices"][0]["delta"].get("content")
            except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                continue
            if piece:
                out.append(piece)
    return out


class Tokens(StatefulProcessor):
    """The pieces of a run's answer in order; the line that is still open is kept, and read when the run has gone quiet."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("tail", "tail string, pos int")

    def _rows(self, run: str, pos: int, pieces: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(run, pos + k, x) for k, x in enumerate(pieces)], columns=["run_id", "pos", "token"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        tail, pos = self.state.get() if self.state.exists() else ("", 0)
        *lines, tail = (tail + "".join(every["chunk"])).split("\n")
        pieces = tokens_of(lines)
        self.state.update((tail, pos + len(pieces)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_millis(every["at"].max()) + self.wait)
        yield self._rows(key[0], pos, pieces)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tail, pos = self.state.get()
        self.state.clear()
        yield self._rows(key[0], pos, tokens_of([tail]))

    def close(self) -> None:
        pass


def answer_tokens(chunks: DataFrame, wait: int = 30_000, late: str = "0 seconds") -> DataFrame:
    """Chunks (run_id, seq, chunk, at) of models' streams, cut anywhere, to (run_id, pos, token). Chunks of a run come in the order of seq, but within a batch.

    After `wait` milliseconds without a chunk the run counts as ended: its open line is read and its state goes.
    """
    keyed = chunks.select("run_id", "seq", "chunk", "at").withWatermark("at", late).groupBy("run_id")
    return keyed.transformWithStateInPandas(Tokens(wait), "run_id string, pos int, token string", "append", "EventTime")


class Tracked(StatefulProcessor):
    """A question with its answer and feedback: handed out once both are there, or with what is there when the time is over."""

    FIELDS = ("question", "answer", "feedback")

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("row", "question string, answer string, feedback string, q_at long, a_at long, f_at long")

    def _row(self, key: str, held: list) -> pd.DataFrame:
        return pd.DataFrame([(key, *held[:3])], columns=["id", *self.FIELDS])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        known = self.state.exists()
        held = list(self.state.get()) if known else [None] * 3 + [-1] * 3
        for k, field in enumerate(self.FIELDS):
            said = every[every[field].notna()]
            for value, at in zip(said[field], said["at"].map(_millis)):
                if at >= held[3 + k]:
                    held[k], held[3 + k] = value, at
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if all(x is not None for x in held[:3]):
            self.state.clear()
            yield self._row(key[0], held)
            return
        self.state.update(tuple(held))
        self.handle.registerTimer(max(held[3:]) + self.wait)
        yield pd.DataFrame([], columns=["id", *self.FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.state.get())
        self.state.clear()
        yield self._row(key[0], held)

    def close(self) -> None:
        pass


def tracked(log: DataFrame, wait: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """A log (id, question, answer, feedback, at), each row with what it tells, to one row for each id: the last of each, once all are there or
    `wait` milliseconds after the last one. What comes after that begins a new row.
    """
    keyed = log.select("id", *Tracked.FIELDS, "at").withWatermark("at", late).groupBy("id")
    return keyed.transformWithStateInPandas(Tracked(wait), "id string, question string, answer string, feedback string", "append", "EventTime")
