"""Queries of carried identities, estimates, schema rules and bounded stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.json import strict_json
from tidemark.operators import compress, gates, ingest, sinks
from tidemark.operators.spend import once
from tidemark.plans.gate_queries import tokens_sql
from tidemark.plans.record_queries import _MESSAGE
from tidemark.sources.tables import table

KEEP = 50
SCHEMA = {
    "type": "object",
    "required": ["provider", "latency_ms"],
    "properties": {"model": {"type": "string"}, "usage": {"type": "object", "required": ["input_tokens"]}, "latency_ms": {"type": "number"}},
}


def ingest_agents(spark: SparkSession, directory: str) -> DataFrame:
    """The agent of every spend fact, carried forward per environment: set at ids ending in 0 or 4, cleared at 8."""
    rows = once(table(spark, directory, "spend")).filter("spend_id IS NOT NULL").select("spend_id", F.try_element_at("tags", F.lit("env")).alias("env"), "model")
    last = F.col("spend_id") % 10
    return ingest.carried(rows, "env", ["spend_id"], F.when(last.isin(0, 4), F.concat(F.coalesce("model", F.lit("none")), last.cast("string"))), last == 8)


def ingest_estimates(spark: SparkSession, directory: str) -> DataFrame:
    """Estimated usage of every recorded response."""
    rows = table(spark, directory, "llm").select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    messages = F.try_variant_get(strict_json("e.request"), "$.messages", "array<variant>")
    rows = rows.withColumn("u", ingest.estimated_usage(messages, ingest.text(F.col("e.response")), ingest.thinking(F.col("e.response"))))
    return rows.select("cassette_id", "arrived_at", "e.seq", "u.*")


def gate_schema(spark: SparkSession, directory: str) -> DataFrame:
    """The first schema fault of the llm_call payloads that have one."""
    rule = gates.json_schema(SCHEMA)
    rows = table(spark, directory, "hashes").filter("entry_type = 'llm_call'").withColumn("v", rule.check(F.col("payload")))
    return rows.filter("v IS NOT NULL").select("case_id", "arrived_at", "v.reason")


def store_recent(spark: SparkSession, directory: str) -> DataFrame:
    """The originals that were used last."""
    uses = table(spark, directory, "documents").filter("text IS NOT NULL AND created_at IS NOT NULL").select(compress.reference(F.col("text")).alias("ref"), F.col("created_at").alias("at"))
    return sinks.recently_used(uses, KEEP)


def sink_spend(spark: SparkSession, directory: str) -> DataFrame:
    """Spend rows in the form of the append-only table."""
    return sinks.spend_rows(table(spark, directory, "spend")).select("spend_id", "ts", "usd", F.md5(F.coalesce("tags", F.lit(""))).alias("tags_md5"), "calls")


QUERIES = {
    "ingest_agents": ingest_agents,
    "ingest_estimates": ingest_estimates,
    "gate_schema": gate_schema,
    "store_recent": store_recent,
    "sink_spend": sink_spend,
}

_E = "(SELECT cassette_id, arrived_at, e.seq AS seq, e.request AS request, e.response AS response FROM (SELECT *, unnest(entries) AS e FROM llm))"
_TEXT = """CASE WHEN json_type(response) = 'ARRAY' THEN array_to_string(list_transform(from_json(response, '["JSON"]'), lambda c: coalesce(json_extract_string(c, '$.choices[0].delta.content'), '')), '')
  ELSE json_extract_string(response, '$.choices[0].message.content') END"""
_GOT = "CASE json_type(payload, '{p}') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END"
SQL = {
    "ingest_agents": """WITH once AS (SELECT spend_id, tags['env'] AS env, model FROM spend WHERE spend_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY spend_id ORDER BY logged_at) = 1),
      seg AS (SELECT *, CASE WHEN spend_id % 10 IN (0, 4) THEN coalesce(model, 'none') || (spend_id % 10) END AS name, sum((spend_id % 10 IN (0, 4, 8))::INT) OVER (PARTITION BY env ORDER BY spend_id) AS n FROM once)
      SELECT spend_id, env, model, max(name) OVER (PARTITION BY env, n) AS agent FROM seg""",
    "ingest_estimates": f"""SELECT cassette_id, arrived_at, seq, CASE WHEN json_type(request, '$.messages') = 'ARRAY' AND json_array_length(request, '$.messages') > 0 THEN
        3 + CAST(list_sum(list_transform(from_json(json_extract(request, '$.messages'), '["JSON"]'), lambda m: 4 + {tokens_sql(f"({_MESSAGE})")})) AS BIGINT) ELSE 0 END AS input,
      coalesce({tokens_sql('text')}, 0) AS output, CAST(0 AS BIGINT) AS reasoning, true AS estimated FROM (SELECT *, {_TEXT} AS text FROM {_E})""",
    "gate_schema": f"""SELECT case_id, arrived_at, reason FROM (SELECT case_id, arrived_at, CASE
        WHEN NOT json_exists(payload, '$.provider') THEN '$: missing required key "provider"'
        WHEN NOT json_exists(payload, '$.latency_ms') THEN '$: missing required key "latency_ms"'
        WHEN json_exists(payload, '$.model') AND json_type(payload, '$.model') <> 'VARCHAR' THEN '$.model: expected string, got ' || {_GOT.format(p='$.model')}
        WHEN json_exists(payload, '$.usage') AND json_type(payload, '$.usage') <> 'OBJECT' THEN '$.usage: expected object, got ' || {_GOT.format(p='$.usage')}
        WHEN json_exists(payload, '$.usage') AND NOT json_exists(payload, '$.usage.input_tokens') THEN '$.usage: missing required key "input_tokens"'
        WHEN json_type(payload, '$.latency_ms') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN '$.latency_ms: expected number, got ' || {_GOT.format(p='$.latency_ms')} END AS reason
      FROM hashes WHERE entry_type = 'llm_call') WHERE reason IS NOT NULL""",
    "sink_spend": """SELECT spend_id, ts, CAST(usd AS VARCHAR) AS usd, md5(coalesce('{' || array_to_string(list_transform(list_sort(map_entries(tags)), lambda e: to_json(e.key) || ':' || to_json(e.value)), ',') || '}', '')) AS tags_md5, calls FROM spend""",
    "store_recent": f"SELECT ref, used AS \"at\" FROM (SELECT sha256(text) AS ref, max(created_at) AS used FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL GROUP BY 1) ORDER BY used DESC, ref LIMIT {KEEP}",
}
