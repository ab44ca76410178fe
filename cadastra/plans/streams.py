"""Batch forms of the event streams, over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.plans.registry import query
from cadastra.sources.tables import table
from cadastra.streaming import events as ev

_KIND = "CASE WHEN role = 'system' THEN 'plan' WHEN role = 'assistant' THEN 'answer_chunk' ELSE 'step' END"


def _runs(spark, d):
    kind = F.when(F.col("role") == "system", "plan").when(F.col("role") == "assistant", "answer_chunk").otherwise("step")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), kind.alias("event"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("data"))


@query(f"SELECT conv_id AS run_id, turn AS seq, 'event: ' || {_KIND} || chr(10) || 'data: ' || replace(text, chr(10), ' ') || chr(10) || chr(10) AS block FROM conversations")
def sse_encode(spark, d):
    return _runs(spark, d).select("run_id", "seq", ev.encode(F.col("event"), F.col("data")).alias("block"))


@query(f"SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, {_KIND} AS event, trim(replace(text, chr(10), ' ')) AS data FROM conversations")
def sse_parse(spark, d):
    # the stream of a run is cut into chunks of 30 characters wherever they end
    chunks = sse_encode(spark, d).select("run_id", "seq", F.posexplode(ev.chunk_text(F.col("block"))).alias("n", "chunk"))
    return ev.parse_runs(chunks.select("run_id", F.struct("seq", "n").alias("seq"), "chunk"))


@query(f"""SELECT conv_id AS run_id, arg_max(replace(text, chr(10), ' '), turn) FILTER (role = 'system') AS plan, coalesce(string_agg(replace(text, chr(10), ' '), '' ORDER BY turn) FILTER (role = 'assistant'), '') AS answer, NULL::VARCHAR AS error FROM conversations GROUP BY conv_id""")
def sse_fold(spark, d):
    return ev.fold(_runs(spark, d))


@query(f"WITH r AS (SELECT conv_id AS run_id, turn, {_KIND} AS event, text FROM conversations) SELECT run_id, event, arg_max(text, turn) AS text, min(turn) AS first_seen FROM r GROUP BY run_id, event")
def sse_latest_step(spark, d):
    rows = _runs(spark, d).join(table(spark, d, "conversations"), (F.col("run_id") == F.col("conv_id")) & (F.col("seq") == F.col("turn")))
    return rows.groupBy("run_id", "event").agg(F.max_by("text", "seq").alias("text"), F.min("seq").alias("first_seen"))


@query("SELECT item_id, i AS pos, text[i * 30 + 1:i * 30 + 30] AS chunk FROM (SELECT item_id, text, unnest(range(ceil(length(text) / 30)::BIGINT)) AS i FROM benchmark)", name="chunk_text")
def chunk_texts(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(ev.chunk_text(F.col("text"))).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT path, count(*) AS views FROM (SELECT DISTINCT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, event_type AS path FROM events) GROUP BY path", name="page_views")
def page_view_counts(spark, d):
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return ev.page_views(table(spark, d, "events").select(session.alias("session_id"), F.col("event_type").alias("path")))


@query("""SELECT user_id AS id, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS question, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS answer,
          arg_max(CAST(props->>'k' AS BIGINT), (ts, event_id)) FILTER (event_type = 'click') AS feedback FROM events GROUP BY user_id""")
def track_latest(spark, d):
    of = lambda kind, c: F.when(F.col("event_type") == kind, c)
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", of("view", F.col("value")).alias("question"), of("purchase", F.col("value")).alias("answer"), of("click", F.get_json_object("props", "$.k").cast("long")).alias("feedback"))
    return ev.latest(log, "id", ["ts", "event_id"], ["question", "answer", "feedback"])
