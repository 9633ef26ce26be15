"""Queries that run a stream over what is there and read the table it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.operators.spend import tag
from tidemark.shipping import ensure_shipped
from tidemark.storage import shared_dir
from tidemark.streaming import stateful


CAP = "5"
#: How long the recorded streams may pause before they count as over.
IDLE_MS = 1000


def _run(spark: SparkSession, stream: DataFrame, name: str, idle_ms: int | None = None) -> DataFrame:
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    stateful.run_available(stream, stateful.append_table(path), name, idle_ms)
    return spark.read.schema(stream.schema).parquet(f"{path}/*")


def stream_budgets(spark: SparkSession, directory: str) -> DataFrame:
    """Spend facts as a stream of calls against a cap per feature: how many are allowed, and what they cost."""
    rows = stateful.read_table(ensure_shipped(spark), directory, "spend")
    calls = rows.select(F.coalesce(tag("feature"), F.lit("none")).alias("key"), F.coalesce("spend_id", F.lit(-1)).alias("call_id"), "ts", "usd")
    out = _run(spark, stateful.budgets(calls, CAP), "budgets")
    return out.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("calls"), F.max("spent").alias("spent"))


def stream_windows(spark: SparkSession, directory: str) -> DataFrame:
    """Events counted per type in windows of an hour, as far as the watermark has closed them."""
    rows = stateful.read_table(ensure_shipped(spark), directory, "events")
    events = rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), F.col("event_id").alias("tokens"))
    return _run(spark, stateful.counters(events, "1 hour", "30 minutes"), "windows")


def stream_calls(spark: SparkSession, directory: str) -> DataFrame:
    """The recorded streams as a stream of chunks, put together again; every third never says that it is over."""
    rows = stateful.read_table(ensure_shipped(spark), directory, "llm")
    rows = rows.select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    call = F.concat_ws("/", "cassette_id", F.unix_micros(F.col("arrived_at").cast("timestamp")).cast("string"), F.col("e.seq").cast("string"))
    parts = rows.select(call.alias("call_id"), F.col("e.seq").alias("seq"), ingest.chunks(F.col("e.response")).alias("p"))
    parts = parts.select("call_id", "seq", F.size("p").alias("n"), F.posexplode("p").alias("idx", "chunk"))
    last = (F.col("idx") == F.col("n") - 1) & (F.col("seq") % 3 != 0)
    chunks = parts.select("call_id", "idx", ingest.chunk_text(F.col("chunk")).alias("text"), last.alias("last"))
    out = _run(spark, stateful.calls_from_chunks(chunks, IDLE_MS), "calls", IDLE_MS)
    return out.select("call_id", F.md5("text").alias("text_md5"), "chunks", "broken")


QUERIES = {"stream_budgets": stream_budgets, "stream_windows": stream_windows, "stream_calls": stream_calls}
SQL = {
    "stream_budgets": f"""WITH per AS (SELECT coalesce(tags['feature'], 'none') AS key, list(CAST(coalesce(usd, 0) AS DECIMAL(38,9)) ORDER BY ts, coalesce(spend_id, -1)) AS calls FROM spend GROUP BY 1),
      fold AS (SELECT key, len(calls) AS calls, list_reduce(list_transform(calls, lambda c: {{'spent': c, 'n': CAST(1 AS BIGINT)}}), lambda a, c: CASE WHEN a.spent + c.spent <= {CAP}
        THEN {{'spent': CAST(a.spent + c.spent AS DECIMAL(38,9)), 'n': a.n + 1}} ELSE a END, {{'spent': CAST(0 AS DECIMAL(38,9)), 'n': CAST(0 AS BIGINT)}}) AS f FROM per)
      SELECT key, f.n AS allowed, calls, f.spent AS spent FROM fold""",
    "stream_windows": """SELECT start, key, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS tokens FROM (SELECT date_trunc('hour', ts) AS start, event_type AS key, event_id FROM events WHERE ts IS NOT NULL)
      WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE GROUP BY ALL""",
    "stream_calls": """SELECT call_id, md5(array_to_string(list_transform(p, lambda c: coalesce(json_extract_string(c, '$.choices[0].delta.content'), '')), '')) AS text_md5, CAST(len(p) AS INT) AS chunks, false AS broken
      FROM (SELECT cassette_id || '/' || epoch_us(arrived_at) || '/' || e.seq AS call_id, from_json(e.response, '["JSON"]') AS p FROM (SELECT *, unnest(entries) AS e FROM llm) WHERE json_type(e.response) = 'ARRAY') WHERE len(p) > 0""",
}
