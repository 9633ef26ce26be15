"""Queries of ledgers, recordings and response shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.json import strict_json
from tidemark.operators import ingest, ledger, replay
from tidemark.sources.recordings import recorded_calls
from tidemark.sources.tables import table


def _chain(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "chain_signed").select("chain_id", "line_no", "line")


def _entries(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "llm").select("cassette_id", "format_version", "recorded_at", "arrived_at", F.explode("entries").alias("e"))
    return rows.select("cassette_id", "format_version", "recorded_at", "arrived_at", "e.*")


def ledger_canonical(spark: SparkSession, directory: str) -> DataFrame:
    """The canonical body of the rows for which it is known, from the entries' fields."""
    rows = table(spark, directory, "hashes").filter("canonical_body IS NOT NULL")
    body = ledger.canonical_body(F.col("seq"), F.col("ts"), F.col("entry_type"), F.col("payload"))
    return rows.select("case_id", "arrived_at", body.alias("body"))


def ledger_hashes(spark: SparkSession, directory: str) -> DataFrame:
    """The hash of every entry, computed from its fields."""
    h = ledger.chain_hash(F.col("prev_hash"), F.col("seq"), F.col("ts"), F.col("entry_type"), F.col("payload"))
    return table(spark, directory, "hashes").select("case_id", "arrived_at", h.alias("hash"))


def ledger_links(spark: SparkSession, directory: str) -> DataFrame:
    """Does each entry's prev_hash name the entry before it? Over the lines as first written."""
    rows = ledger.once(_chain(spark, directory)).filter(F.get_json_object("line", "$.hash").isNotNull())
    rows = rows.select("chain_id", "line_no", F.get_json_object("line", "$.prev_hash").alias("prev_hash"), F.get_json_object("line", "$.hash").alias("hash"))
    return ledger.linked(rows).select("chain_id", "line_no", "position", "link")


def ledger_verify(spark: SparkSession, directory: str) -> DataFrame:
    """Verification of every ledger as it was delivered."""
    return ledger.verify(_chain(spark, directory))


def ledger_verify_once(spark: SparkSession, directory: str) -> DataFrame:
    """Verification of every ledger after blank, cut and repeated lines are left out."""
    return ledger.verify(ledger.once(_chain(spark, directory)))


def ledger_steps(spark: SparkSession, directory: str) -> DataFrame:
    """The step of every readable entry within its decision."""
    rows = _chain(spark, directory).filter(strict_json("line").isNotNull())
    rows = rows.select("chain_id", "line_no", F.get_json_object("line", "$.payload.decision_id").alias("decision_id")).filter("decision_id IS NOT NULL")
    return ledger.step_index(rows, "decision_id", ["chain_id", "line_no"]).select("chain_id", "line_no", "decision_id", "step")


def replay_hashes(spark: SparkSession, directory: str) -> DataFrame:
    """The hash of every recorded request, computed from the request."""
    return _entries(spark, directory).select("cassette_id", "arrived_at", "seq", replay.request_hash("request", "format_version").alias("request_hash"))


def _split(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Recorded entries (of March's first half of cassettes by parity) and live ones."""
    rows = _entries(spark, directory).filter("request_hash IS NOT NULL").select("cassette_id", "arrived_at", "seq", "request_hash", "response", F.col("recorded_at").alias("at"))
    even = F.substring("cassette_id", -1, 1).cast("int") % 2 == 0
    return rows.filter(even), rows.filter(~even)


def replay_matched(spark: SparkSession, directory: str) -> DataFrame:
    """The n-th live occurrence of a request with the n-th recorded one."""
    recorded, live = _split(spark, directory)
    order = ["cassette_id", "arrived_at", "seq"]
    return replay.match(recorded.select("request_hash", *order), live.select("request_hash", *order), order)


def replay_drift(spark: SparkSession, directory: str) -> DataFrame:
    """Requests that were both recorded and live, and whether the response changed."""
    return replay.drift(*_split(spark, directory))


#: One response of each shape that providers have: (provider, response, usage or null, text or null).
SHAPES: list[tuple[str, str, tuple[int, ...] | None, str | None]] = [
    ("openai", '{"choices":[{"message":{"content":"first"}}],"usage":{"prompt_tokens":10,"completion_tokens":4,"prompt_tokens_details":{"cached_tokens":3},"completion_tokens_details":{"reasoning_tokens":2}}}', (10, 4, 3, 2, 0), "first"),
    ("openai_responses", '{"output_text":"second","usage":{"input_tokens":8,"output_tokens":5,"input_tokens_details":{"cached_tokens":1},"output_tokens_details":{"reasoning_tokens":4}}}', (8, 5, 1, 4, 0), "second"),
    ("openai_embeddings", '{"data":[],"usage":{"prompt_tokens":6,"total_tokens":6}}', (6, 0, 0, 0, 0), None),
    ("anthropic", '{"content":[{"type":"text","text":"third, "},{"type":"tool_use"},{"type":"text","text":"part two"}],"usage":{"input_tokens":20,"output_tokens":7,"cache_read_input_tokens":15,"cache_creation_input_tokens":9}}', (35, 7, 15, 0, 9), "third, part two"),
    ("google", '{"text":"fourth","usageMetadata":{"promptTokenCount":11,"candidatesTokenCount":3,"thoughtsTokenCount":6}}', (11, 9, 0, 6, 0), "fourth"),
    ("google", '{"candidates":[{"content":{"parts":[{"text":"fif"},{"text":"th"}]}}],"usage_metadata":{"prompt_token_count":2,"candidates_token_count":1}}', (2, 1, 0, 0, 0), "fifth"),
    ("ollama", '{"message":{"content":"sixth"},"prompt_eval_count":12,"eval_count":13}', (12, 13, 0, 0, 0), "sixth"),
    ("bedrock", '{"output":{"message":{"content":[{"text":"sev"},{"text":"enth"}]}},"usage":{"inputTokens":14,"outputTokens":2}}', (14, 2, 0, 0, 0), "seventh"),
    ("anthropic", '[{"type":"message_start","message":{"usage":{"input_tokens":5,"cache_read_input_tokens":2,"cache_creation_input_tokens":1}}},{"type":"content_block_delta","delta":{"text":"a"}},{"type":"content_block_delta","delta":{"text":"b"}},{"type":"message_delta","usage":{"output_tokens":3}},{"type":"message_delta","usage":{"output_tokens":9}}]', (7, 9, 2, 0, 1), "ab"),
    ("google", '[{"text":"x","usageMetadata":{"promptTokenCount":4,"candidatesTokenCount":1}},{"text":"y","usageMetadata":{"promptTokenCount":4,"candidatesTokenCount":7,"thoughtsTokenCount":2}}]', (4, 9, 0, 2, 0), "xy"),
    ("bedrock", '[{"contentBlockDelta":{"delta":{"text":"p"}}},{"contentBlockDelta":{"delta":{"text":"q"}}},{"metadata":{"usage":{"inputTokens":3,"outputTokens":8}}}]', (3, 8, 0, 0, 0), "pq"),
    ("openai_responses", '[{"type":"response.output_text.delta","delta":"m"},{"type":"response.output_text.delta","delta":"n"},{"type":"response.completed","response":{"usage":{"input_tokens":9,"output_tokens":2}}}]', (9, 2, 0, 0, 0), "mn"),
    ("openai", '[{"choices":[{"delta":{"content":"r"}},{"delta":{"content":"s"}}]},{"choices":[],"usage":{"prompt_tokens":1,"completion_tokens":2}}]', (1, 2, 0, 0, 0), "rs"),
    ("anthropic", '{"usage":{"prompt_tokens":5}}', None, None),
    ("google", '{"usage":{"input_tokens":5}}', None, None),
    ("openai", '{"usage":{"prompt_tokens":"many"}} trailing', None, None),
]


def _shapes(spark: SparkSession, directory: str) -> DataFrame:
    """Every ledger case with one of the SHAPES, by its number."""
    shape = F.get(F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(r).alias("response")) for p, r, _, _ in SHAPES)), (F.col("case_id") % len(SHAPES)).cast("int"))
    return table(spark, directory, "hashes").select("case_id", "arrived_at", shape.alias("s")).select("case_id", "arrived_at", "s.*")


def ingest_usage_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """The usage of a response of every shape, by its provider's rule."""
    rows = _shapes(spark, directory).withColumn("u", ingest.usage(F.col("response"), F.col("provider")))
    return rows.select("case_id", "arrived_at", "provider", *(F.col(f"u.{c}").alias(c) for c in ingest.COUNTS))


def ingest_text_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """The assistant's text of a response of every shape."""
    return _shapes(spark, directory).select("case_id", "arrived_at", ingest.text(F.col("response")).alias("text"))


def ingest_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Calls from the starts and ends of runs in a tree over the ledger's cases.

    Case n runs under case n // 3, tens begin a tree; every fourth is a chain with a name on every eighth, the others are models and tools by turns, every 7th of them fails.
    """
    case = F.col("case_id")
    rows = table(spark, directory, "hashes").filter("case_id IS NOT NULL").select("case_id").distinct()
    kind = F.when(case % 4 == 0, "chain").when(case % 4 == 1, "llm").otherwise("tool")
    name = F.when(kind == "chain", F.when(case % 8 == 0, F.concat(F.lit("agent"), case.cast("string")))).when(kind == "tool", F.concat(F.lit("tool"), (case % 5).cast("string")))
    result = F.concat(F.lit('{"generations":[[{"message":{"usage_metadata":{"input_tokens":'), (case % 100).cast("string"), F.lit(',"output_tokens":"7","input_token_details":{"cache_read":2}}}}]],"llmOutput":{"model_name":"m'), (case % 3).cast("string"), F.lit('"}}'))
    body = F.when(kind == "llm", result).otherwise(F.lit("done"))
    failed = case % 7 == 0
    runs = rows.select(case.cast("string").alias("run"), F.when(case % 10 != 0, F.floor(case / 3).cast("string")).alias("parent"), kind.alias("kind"), name.alias("name"), body.alias("result"), failed.alias("failed"))
    start = F.struct(F.lit("start").alias("event"), "name", F.lit("in").alias("body"))
    end = F.struct(F.when(F.col("failed"), "error").otherwise("end").alias("event"), F.lit(None).cast("string").alias("name"), F.when(F.col("failed"), "broken").otherwise(F.col("result")).alias("body"))
    events = runs.select("run", "parent", "kind", F.explode(F.array(start, end)).alias("e")).select("run", "parent", "kind", "e.*")
    return ingest.run_calls(events).select("run", "kind", "name", "error", "model", "root", "agent", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"), F.col("usage.cached").alias("cached"))


def ingest_payloads(spark: SparkSession, directory: str) -> DataFrame:
    """The text that rules read of every recorded request's messages."""
    messages = F.get_json_object("request", "$.messages")
    return _entries(spark, directory).select("cassette_id", "arrived_at", "seq", F.md5(ingest.payload_text(messages)).alias("text_md5"))


def ingest_usage(spark: SparkSession, directory: str) -> DataFrame:
    """Token usage of every recorded response, streamed or not."""
    rows = _entries(spark, directory).withColumn("u", ingest.usage(F.col("response"), F.get_json_object("request", "$.provider")))
    return rows.select("cassette_id", "arrived_at", "seq", "u.input", "u.output", "u.cached", "u.total")


def ingest_texts(spark: SparkSession, directory: str) -> DataFrame:
    """The assistant's text of every recorded response."""
    return _entries(spark, directory).select("cassette_id", "arrived_at", "seq", ingest.text(F.col("response")).alias("text"))


def ingest_attributes(spark: SparkSession, directory: str) -> DataFrame:
    """Model and tokens from telemetry attributes, made from the payloads with one of two alias sets."""
    get = lambda p: F.get_json_object("payload", p)
    odd = F.col("case_id") % 2 == 1
    key = lambda a, b: F.when(odd, a).otherwise(b)
    attrs = F.create_map(
        key("gen_ai.request.model", "gen_ai.response.model"), get("$.model"),
        key("gen_ai.system", "gen_ai.provider.name"), get("$.provider"),
        key("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens"), get("$.usage.input_tokens"),
        key("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens"), get("$.usage.output_tokens"),
        key("gen_ai.usage.cached_tokens", "gen_ai.usage.cache_read_input_tokens"), get("$.usage.cached_tokens"),
        F.lit("gen_ai.usage.reasoning_tokens"), get("$.usage.reasoning_tokens"),
    )
    rows = table(spark, directory, "hashes").filter("entry_type = 'llm_call'")
    return rows.select("case_id", "arrived_at", ingest.attributes(attrs).alias("a")).select("case_id", "arrived_at", "a.*")


def ingest_spans(spark: SparkSession, directory: str) -> DataFrame:
    """The spend facts as spans: their start and the attributes that are set."""
    rows = ingest.spans(table(spark, directory, "spend").withColumn("latency_ms", (F.col("spend_id") % 1000).cast("double")))
    return rows.select("spend_id", "logged_at", "start", "end", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";").alias("attributes"))


def ingest_roots(spark: SparkSession, directory: str) -> DataFrame:
    """Root and depth of runs in a tree over the spend ids (the parent of n is n // 3; multiples of 1000 begin a tree)."""
    runs = table(spark, directory, "spend").select("spend_id").distinct()
    parent = F.when(F.col("spend_id") % 1000 != 0, F.floor(F.col("spend_id") / 3))
    return ingest.roots(runs.withColumn("parent", parent), "spend_id", "parent")


#: A framework's tables for the queries: controls of entry types, and of the tools that are called.
BY_TYPE = {"llm_call": ["Log-1 logging", "Log-7 monitoring"], "tool_call": ["Log-1 logging"], "decision": ["Rec-3 record-keeping", "Exp-2 transparency"], "human_oversight": ["Ovr-4 oversight"]}
BY_TOOL = {"ledger_get": ["Fin-1 finance", "Log-1 logging"], "search": ["Src-2 sources"]}


def ledger_framework(spark: SparkSession, directory: str) -> DataFrame:
    """What a framework says of every readable entry; tool calls get the controls of their tools too."""
    rows = _chain(spark, directory).filter(strict_json("line").isNotNull())
    rows = ledger.mapped_controls(rows, BY_TYPE, BY_TOOL, "tool_call", "$.payload.name")
    return rows.select("chain_id", "line_no", F.array_join("controls", ";").alias("controls"))


def ledger_evidence(spark: SparkSession, directory: str) -> DataFrame:
    """The headers of the evidence packs of every ledger as first written: entries, head and covered controls."""
    packs = ledger.evidence(ledger.once(_chain(spark, directory)), "own", by_type=BY_TYPE, by_key=BY_TOOL, flag_type="tool_call", keys="$.payload.name")
    get = lambda p: F.get_json_object("line", f"$._meta.{p}")
    covered = F.array_join(F.from_json(get("controls_covered"), "array<string>"), ";")
    return packs.filter("position = -1").select("chain_id", get("entries").cast("long").alias("entries"), get("head_hash").alias("head"), covered.alias("controls"), get("summary.llm_calls").cast("long").alias("llm_calls"))


def ledger_decisions(spark: SparkSession, directory: str) -> DataFrame:
    """Every entry of the ledgers as first written with the decision that it belongs to."""
    return ledger.with_decisions(ledger.once(_chain(spark, directory)))


def ingest_calls(spark: SparkSession, directory: str) -> DataFrame:
    """The recorded calls as one normalized table."""
    rows = recorded_calls(table(spark, directory, "llm"))
    return rows.select("cassette_id", "seq", "arrived_at", "kind", "provider", "model", "messages", F.md5("text").alias("text_md5"), F.col("usage.total").alias("total"))


QUERIES = {
    "ledger_decisions": ledger_decisions,
    "ledger_budget_events": lambda s, d: ledger.event_counts(ledger.once(_chain(s, d)), "budget_event", {"action": "action", "model": "model", "to_model": "to_model"}),
    "ledger_guard_decisions": lambda s, d: ledger.event_counts(ledger.once(_chain(s, d)), "guardrail_decision", {"guardrail": "guardrail", "stage": "stage", "action": "action"}),
    "ingest_calls": ingest_calls,
    "ledger_framework": ledger_framework,
    "ledger_evidence": ledger_evidence,
    "ledger_canonical": ledger_canonical,
    "ledger_hashes": ledger_hashes,
    "ledger_links": ledger_links,
    "ledger_verify": ledger_verify,
    "ledger_verify_once": ledger_verify_once,
    "ledger_summary": lambda s, d: ledger.summary(_chain(s, d).filter(strict_json("line").isNotNull())),
    "ledger_controls": lambda s, d: ledger.controls(_chain(s, d).filter(strict_json("line").isNotNull())).select("chain_id", F.array_join("controls", ";").alias("controls")),
    "ledger_steps": ledger_steps,
    "replay_hashes": replay_hashes,
    "replay_matched": replay_matched,
    "replay_drift": replay_drift,
    "ingest_usage": ingest_usage,
    "ingest_usage_shapes": ingest_usage_shapes,
    "ingest_text_shapes": ingest_text_shapes,
    "ingest_runs": ingest_runs,
    "ingest_payloads": ingest_payloads,
    "ingest_texts": ingest_texts,
    "ingest_attributes": ingest_attributes,
    "ingest_spans": ingest_spans,
    "ingest_roots": ingest_roots,
}

_READ = "(SELECT * FROM chain_signed WHERE json_valid(line))"
_E = "(SELECT cassette_id, format_version, recorded_at, arrived_at, e.seq AS seq, e.request_hash AS request_hash, e.request AS request, e.response AS response FROM (SELECT *, unnest(entries) AS e FROM llm))"
_STREAM = """from_json(response, '["JSON"]')"""
_J = "json_extract_string"
_CHUNK = f"list_filter({_STREAM}, lambda c: {_J}(c, '$.usage.prompt_tokens') IS NOT NULL)[1]"
_SRC = f"CASE WHEN json_type(response) = 'ARRAY' THEN {_CHUNK} ELSE response::JSON END"
_quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
_VALUES = ", ".join(f"({i}, {', '.join(map(_quote, (p, *(u or (None,) * 5), t)))})" for i, (p, _, u, t) in enumerate(SHAPES))
_SHAPE = f"(VALUES {_VALUES}) AS s(i, provider, input, output, cached, reasoning, cache_write, text)"
_MESSAGE = f"""CASE json_type(m, '$.content') WHEN 'ARRAY' THEN array_to_string(list_transform(from_json(json_extract(m, '$.content'), '["JSON"]'), lambda p: coalesce({_J}(p, '$.text'), '')), '')
  ELSE coalesce({_J}(m, '$.content'), '') END"""
def _verify_sql(lines: str) -> str:
    """Links, completeness and heads of ledgers; that the hashes are those of their entries is the part of ``ledger_hashes``."""
    return f"""WITH line AS (SELECT chain_id, line_no, line, json_valid(line) AS readable FROM {lines} WHERE regexp_matches(line, '\\S')),
      entry AS (SELECT chain_id, line_no, {_J}(line, '$.hash') AS h, CASE WHEN {_J}(line, '$.prev_hash') IS DISTINCT FROM lag({_J}(line, '$.hash'), 1, repeat('0', 64)) OVER (PARTITION BY chain_id ORDER BY line_no)
        THEN 'broken link at seq ' || coalesce({_J}(line, '$.seq'), 'null') || ': prev_hash mismatch' END AS fault FROM line WHERE readable AND NOT json_exists(line, '$._meta')),
      every AS (SELECT chain_id, line_no, h, fault, NULL AS meta FROM entry UNION ALL SELECT chain_id, line_no, NULL, 'corrupt log: unreadable line', NULL FROM line WHERE NOT readable
        UNION ALL SELECT chain_id, line_no, NULL, NULL, json_extract(line, '$._meta') FROM line WHERE readable AND json_exists(line, '$._meta')),
      found AS (SELECT chain_id, arg_min(fault, line_no) FILTER (fault IS NOT NULL) AS fault, count(h) AS n, coalesce(arg_max(h, line_no) FILTER (h IS NOT NULL), repeat('0', 64)) AS head, arg_max(meta, line_no) FILTER (meta IS NOT NULL) AS meta FROM every GROUP BY chain_id),
      told AS (SELECT *, CASE WHEN fault IS NOT NULL THEN fault WHEN {_J}(meta, '$.head_hash') <> head THEN 'incomplete log: head differs'
        WHEN CAST({_J}(meta, '$.entries') AS BIGINT) <> n THEN 'incomplete log: found ' || n || ' entries, expected ' || {_J}(meta, '$.entries') END AS detail FROM found)
      SELECT chain_id, detail IS NULL AS ok, coalesce(detail, 'ok') AS detail, n AS entries, head FROM told"""


_ONCE = f"""(SELECT chain_id, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM {_READ} GROUP BY chain_id, coalesce({_J}(line, '$.hash'), 'meta' || {_J}(line, '$._meta.head_hash')))"""
_SIGN = f"""(SELECT r.request_hash, r.seen, r.odd, string_agg(t.fullkey || t.type || coalesce(CAST(t.atom AS VARCHAR), ''), '|' ORDER BY t.fullkey) AS sign FROM
  (SELECT row_number() OVER () AS n, request_hash, recorded_at AS seen, CAST(cassette_id[-1:] AS INT) % 2 AS odd, response FROM {_E} WHERE request_hash IS NOT NULL AND json_valid(response)) r, json_tree(r.response) t GROUP BY r.n, r.request_hash, r.seen, r.odd
  UNION ALL SELECT request_hash, recorded_at, CAST(cassette_id[-1:] AS INT) % 2, NULL FROM {_E} WHERE request_hash IS NOT NULL AND response IS NULL)"""
_MAPPED = ", ".join(f"('{k}', {v!r})" for k, v in BY_TYPE.items())
_TOOLS = ", ".join(f"('{k}', {v!r})" for k, v in BY_TOOL.items())
_CONTROLS = f"""(SELECT chain_id, line_no, line, list_concat(coalesce(m.c, []), list_filter(coalesce(t.c, []), lambda x: NOT list_contains(coalesce(m.c, []), x))) AS c FROM {{lines}} l
  LEFT JOIN (VALUES {_MAPPED}) AS m(k, c) ON m.k = {_J}(line, '$.type') LEFT JOIN (VALUES {_TOOLS}) AS t(k, c) ON {_J}(line, '$.type') = 'tool_call' AND t.k = {_J}(line, '$.payload.name'))"""
_P = lambda name: f"{_J}(line, '$.payload.{name}')"
SQL = {
    "ledger_budget_events": f"SELECT {_P('action')} AS action, {_P('model')} AS model, {_P('to_model')} AS to_model, count(*) AS n FROM {_ONCE} WHERE {_J}(line, '$.type') = 'budget_event' GROUP BY ALL",
    "ledger_guard_decisions": f"SELECT {_P('guardrail')} AS guardrail, {_P('stage')} AS stage, {_P('action')} AS action, count(*) AS n FROM {_ONCE} WHERE {_J}(line, '$.type') = 'guardrail_decision' GROUP BY ALL",
    "ledger_decisions": f"""WITH e AS (SELECT chain_id, line_no, {_J}(line, '$.type') AS type, {_P('decision_id')} AS decision_id, {_P('actor')} AS actor FROM {_ONCE} WHERE {_P('decision_id')} IS NOT NULL),
      d AS (SELECT chain_id, decision_id, arg_min({{'a': actor}}, line_no).a AS actor, min(line_no) AS decided FROM e WHERE type = 'decision' GROUP BY ALL)
      SELECT e.chain_id, line_no, type, e.decision_id, d.actor, decided FROM e LEFT JOIN d USING (chain_id, decision_id)""",
    "ingest_calls": f"""SELECT cassette_id, seq, arrived_at, kind, {_J}(request, '$.provider') AS provider, {_J}(request, '$.model') AS model, CASE WHEN json_type(request, '$.messages') = 'ARRAY' THEN CAST(json_array_length(request, '$.messages') AS INT) END AS messages,
      md5(CASE WHEN json_type(response) = 'ARRAY' THEN nullif(array_to_string(list_transform({_STREAM}, lambda c: coalesce({_J}(c, '$.choices[0].delta.content'), '')), ''), '') ELSE {_J}(response, '$.choices[0].message.content') END) AS text_md5,
      TRY_CAST({_J}({_SRC}, '$.usage.prompt_tokens') AS BIGINT) + coalesce(TRY_CAST({_J}({_SRC}, '$.usage.completion_tokens') AS BIGINT), 0) AS total FROM (SELECT cassette_id, arrived_at, e.seq AS seq, e.kind AS kind, e.request AS request, e.response AS response FROM (SELECT *, unnest(entries) AS e FROM llm)) WHERE json_valid(request)""",
    "ledger_framework": f"SELECT chain_id, line_no, array_to_string(c, ';') AS controls FROM {_CONTROLS.format(lines=_READ)}",
    "ledger_evidence": f"""SELECT chain_id, count(*) AS entries, arg_max({_J}(line, '$.hash'), line_no) AS head, array_to_string(list_sort(list_distinct(flatten(list(c)))), ';') AS controls,
      count(*) FILTER ({_J}(line, '$.type') = 'llm_call') AS llm_calls FROM {_CONTROLS.format(lines=_ONCE)} WHERE NOT json_exists(line, '$._meta') GROUP BY chain_id""",
    "ledger_verify": _verify_sql("chain_signed"),
    "ledger_verify_once": _verify_sql(_ONCE),
    "replay_drift": f"""WITH s AS (SELECT * FROM {_SIGN}), was AS (SELECT request_hash, arg_min({{'v': sign}}, seen) AS w FROM s WHERE odd = 0 GROUP BY 1), now AS (SELECT request_hash, arg_max({{'v': sign}}, seen) AS w FROM s WHERE odd = 1 GROUP BY 1)
      SELECT request_hash, was.w.v IS DISTINCT FROM now.w.v AS changed FROM was JOIN now USING (request_hash)""",
    "ingest_usage_shapes": f"SELECT case_id, arrived_at, provider, CAST(input AS BIGINT) AS input, CAST(output AS BIGINT) AS output, CAST(cached AS BIGINT) AS cached, CAST(reasoning AS BIGINT) AS reasoning, CAST(cache_write AS BIGINT) AS cache_write FROM hashes LEFT JOIN {_SHAPE} ON case_id % {len(SHAPES)} = i",
    "ingest_text_shapes": f"SELECT case_id, arrived_at, text FROM hashes LEFT JOIN {_SHAPE} ON case_id % {len(SHAPES)} = i",
    "ingest_payloads": f"""SELECT cassette_id, arrived_at, seq, CASE WHEN json_type(request, '$.messages') = 'ARRAY' THEN md5(array_to_string(list_transform(list_filter(from_json(json_extract(request, '$.messages'), '["JSON"]'), lambda m: json_type(m) <> 'NULL'), lambda m: {_MESSAGE}), chr(10))) END AS text_md5 FROM {_E}""",
    "ingest_runs": """WITH RECURSIVE run AS (SELECT DISTINCT case_id AS id, CASE WHEN case_id % 10 <> 0 THEN case_id // 3 END AS parent, CASE WHEN case_id % 4 = 0 THEN 'chain' WHEN case_id % 4 = 1 THEN 'llm' ELSE 'tool' END AS kind,
        CASE WHEN case_id % 8 = 0 THEN 'agent' || case_id END AS own FROM hashes WHERE case_id IS NOT NULL),
      fixed AS (SELECT r.id, r.own, r.kind, CASE WHEN p.id <> r.id THEN p.id END AS parent FROM run r LEFT JOIN run p ON r.parent = p.id),
      up AS (SELECT id, id AS top, parent, 0 AS depth, own FROM fixed UNION ALL SELECT up.id, f.id, f.parent, depth + 1, f.own FROM up JOIN fixed f ON up.parent = f.id),
      of AS (SELECT id, arg_max(top, depth) AS root, arg_min(own, depth) FILTER (own IS NOT NULL) AS agent FROM up GROUP BY id)
      SELECT CAST(id AS VARCHAR) AS run, kind, CASE WHEN kind = 'tool' THEN 'tool' || (id % 5) END AS name, CASE WHEN id % 7 = 0 THEN 'broken' END AS error,
        CASE WHEN kind = 'llm' THEN CASE WHEN id % 7 = 0 THEN '' ELSE 'm' || (id % 3) END END AS model, CAST(root AS VARCHAR) AS root, agent,
        CASE WHEN kind = 'llm' AND id % 7 <> 0 THEN id % 100 END AS input, CASE WHEN kind = 'llm' AND id % 7 <> 0 THEN 7 END AS output, CASE WHEN kind = 'llm' AND id % 7 <> 0 THEN 2 END AS cached
      FROM fixed JOIN of USING (id) WHERE kind <> 'chain'""",
    "ledger_canonical": "SELECT case_id, arrived_at, canonical_body AS body FROM hashes WHERE canonical_body IS NOT NULL",
    "ledger_hashes": "SELECT case_id, arrived_at, hash FROM hashes",
    "ledger_links": f"""WITH line AS (SELECT chain_id, line_no, {_J}(line, '$.prev_hash') AS prev_hash, {_J}(line, '$.hash') AS hash FROM {_READ} WHERE {_J}(line, '$.hash') IS NOT NULL),
      once AS (SELECT chain_id, min(line_no) AS line_no, prev_hash, hash FROM line GROUP BY chain_id, prev_hash, hash)
      SELECT chain_id, line_no, row_number() OVER w - 1 AS position, prev_hash IS NOT DISTINCT FROM lag(hash, 1, repeat('0', 64)) OVER w AS link FROM once WINDOW w AS (PARTITION BY chain_id ORDER BY line_no)""",
    "ledger_summary": f"""SELECT chain_id, count(*) AS entries, {", ".join(f"count(*) FILTER (t = '{t}') AS {t}s" for t in ("decision", "llm_call", "tool_call", "human_oversight"))},
      {", ".join(f"count(*) FILTER (t = 'guardrail_decision' AND a = '{a}') AS {a}_actions" for a in ("flag", "block", "redact"))}
      FROM (SELECT chain_id, {_J}(line, '$.type') AS t, {_J}(line, '$.payload.action') AS a FROM {_READ}) WHERE t IS NOT NULL GROUP BY chain_id""",
    "ledger_controls": f"""SELECT chain_id, array_to_string(list_sort(list(DISTINCT c)), ';') AS controls FROM (SELECT chain_id, unnest(from_json(json_extract(line, '$.controls'), '["VARCHAR"]')) AS c FROM {_READ}) WHERE c IS NOT NULL GROUP BY chain_id""",
    "ledger_steps": f"""SELECT *, CAST(row_number() OVER (PARTITION BY decision_id ORDER BY chain_id, line_no) AS INT) AS step FROM (SELECT chain_id, line_no, {_J}(line, '$.payload.decision_id') AS decision_id FROM {_READ}) WHERE decision_id IS NOT NULL""",
    "replay_hashes": f"SELECT cassette_id, arrived_at, seq, request_hash FROM {_E}",
    "replay_matched": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY request_hash, CAST(cassette_id[-1:] AS INT) % 2 ORDER BY cassette_id, arrived_at, seq) - 1 AS position,
        CAST(cassette_id[-1:] AS INT) % 2 AS odd FROM {_E} WHERE request_hash IS NOT NULL)
      SELECT l.request_hash, l.cassette_id, l.arrived_at, l.seq, l.position, r.cassette_id AS rec_cassette_id, r.arrived_at AS rec_arrived_at, r.seq AS rec_seq, r.request_hash IS NOT NULL AS found
      FROM r l LEFT JOIN r ON r.odd = 0 AND r.request_hash = l.request_hash AND r.position = l.position WHERE l.odd = 1""",
    "ingest_usage": f"""SELECT cassette_id, arrived_at, seq, input, CASE WHEN input IS NOT NULL THEN coalesce(output, 0) END AS output,
      CASE WHEN input IS NOT NULL THEN coalesce(cached, 0) END AS cached, input + coalesce(output, 0) AS total FROM (SELECT cassette_id, arrived_at, seq, TRY_CAST({_J}(s, '$.usage.prompt_tokens') AS BIGINT) AS input,
      TRY_CAST({_J}(s, '$.usage.completion_tokens') AS BIGINT) AS output, TRY_CAST({_J}(s, '$.usage.prompt_tokens_details.cached_tokens') AS BIGINT) AS cached FROM (SELECT *, {_SRC} AS s FROM {_E}))""",
    "ingest_texts": f"""SELECT cassette_id, arrived_at, seq, CASE WHEN json_type(response) = 'ARRAY' THEN
      nullif(array_to_string(list_transform({_STREAM}, lambda c: coalesce({_J}(c, '$.choices[0].delta.content'), '')), ''), '') ELSE {_J}(response, '$.choices[0].message.content') END AS text FROM {_E}""",
    "ingest_attributes": f"""SELECT case_id, arrived_at, coalesce({_J}(payload, '$.model'), '') AS model, coalesce({_J}(payload, '$.provider'), '') AS provider, TRY_CAST({_J}(payload, '$.usage.input_tokens') AS BIGINT) AS input,
      {", ".join(f"CASE WHEN TRY_CAST({_J}(payload, '$.usage.input_tokens') AS BIGINT) IS NOT NULL THEN coalesce(TRY_CAST({_J}(payload, '$.usage.{c}_tokens') AS BIGINT), 0) END AS {c}" for c in ("output", "cached", "reasoning"))} FROM hashes WHERE entry_type = 'llm_call'""",
    "ingest_spans": """SELECT spend_id, logged_at, ts - to_milliseconds(spend_id % 1000) AS start, ts AS "end",
      array_to_string(list_filter(['gen_ai.input_tokens=' || input_tokens, 'gen_ai.model=' || model, 'gen_ai.output_tokens=' || output_tokens, 'gen_ai.reasoning_tokens=' || nullif(reasoning_tokens, 0)], lambda x: x IS NOT NULL), ';') AS attributes FROM spend""",
    "ingest_roots": """WITH RECURSIVE run AS (SELECT DISTINCT spend_id AS id, CASE WHEN spend_id % 1000 <> 0 THEN spend_id // 3 END AS parent FROM spend WHERE spend_id IS NOT NULL),
      fixed AS (SELECT r.id, CASE WHEN p.id <> r.id THEN p.id END AS parent FROM run r LEFT JOIN run p ON r.parent = p.id),
      up AS (SELECT id, id AS top, parent, 0 AS depth FROM fixed UNION ALL SELECT up.id, f.id, f.parent, depth + 1 FROM up JOIN fixed f ON up.parent = f.id)
      SELECT id AS spend_id, top AS root, depth FROM up WHERE parent IS NULL""",
}
