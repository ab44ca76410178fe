"""Stateful streams over files that come one after the other, with a restart from the checkpoint in between."""

import json
from datetime import datetime, timedelta

import pytest

from cadastra.streaming import stateful as sf

START = datetime(2024, 1, 1)


def at(ms):
    return (START + timedelta(milliseconds=ms)).isoformat(timespec="milliseconds")


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over batches of rows; each call goes on from the checkpoint, with a new query."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sf.STORE)

    def run(make, schema, batches, name):
        for rows in batches:
            n = len(list((tmp_path / name).glob("*.json"))) if (tmp_path / name).exists() else 0
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"{n:03}.json").write_text("\n".join(map(json.dumps, rows)))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
        query = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}-out").collect()]

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_debounce(stream):
    row = lambda k, v, ms: {"key": k, "value": v, "at": at(ms)}
    make = lambda s: sf.debounced(s, 250)
    schema = "key string, value string, at timestamp"
    first = stream(make, schema, [[row("a", "d", 0), row("a", "de", 100), row("b", "x", 0)], [row("a", "dea", 300)]], "typed")
    # b has come to rest, a is still being typed
    assert sorted(r[:2] for r in first) in ([], [("b", "x")])
    second = stream(make, schema, [[row("a", "dean", 500), row("a", "new", 2000)], [row("z", "end", 60_000)], [row("z", "more", 90_000)]], "typed")
    assert sorted(r[:2] for r in second)[:3] == [("a", "dean"), ("a", "new"), ("b", "x")] and ("z", "more") not in [r[:2] for r in second]


def test_tokens(stream):
    said = ["The ", "lot", " is\n", "", "é漢"]
    line = lambda x: "data: " + json.dumps({"choices": [{"delta": {"content": x}}]}, ensure_ascii=False) + "\n"
    whole = ": comment\n" + "".join(map(line, said)) + "data: not json\ndata: {}\ndata: [DONE]\n" + line("open").rstrip("\n")
    cut = [whole[i : i + 7] for i in range(0, len(whole), 7)]
    rows = [{"run_id": "r", "seq": i, "chunk": c, "at": at(i)} for i, c in enumerate(cut)]
    schema = "run_id string, seq long, chunk string, at timestamp"
    make = lambda s: sf.answer_tokens(s, 1000)
    half = len(rows) // 2
    first = stream(make, schema, [rows[:3], rows[3:half]], "chunks")
    assert len(first) < 4
    end = [{"run_id": "other", "seq": 0, "chunk": "", "at": at(t)} for t in (60_000, 90_000)]
    got = stream(make, schema, [rows[half:], end[:1], end[1:]], "chunks")
    # the open line is read by the timer
    assert [r[2] for r in sorted(r for r in got if r[0] == "r")] == ["The ", "lot", " is\n", "é漢", "open"]


def test_tracked(stream):
    row = lambda i, ms, **said: {"id": i, "question": None, "answer": None, "feedback": None, "at": at(ms)} | said
    schema = "id string, question string, answer string, feedback string, at timestamp"
    make = lambda s: sf.tracked(s, 5000)
    assert stream(make, schema, [[row("1", 0, question="q1"), row("2", 0, question="q2")], [row("1", 10, answer="old"), row("1", 20, answer="a1")]], "log") == []
    got = stream(make, schema, [[row("1", 30, feedback="good"), row("2", 40, answer="a2")], [row("3", 60_000, question="late")], [row("4", 90_000, question="later")]], "log")
    assert sorted(r for r in got if r[0] in "12") == [("1", "q1", "a1", "good"), ("2", "q2", "a2", None)]
