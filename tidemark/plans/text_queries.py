"""Queries of token estimates, compression and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.json import strict_json
from tidemark.operators import assembly, compress, packing
from tidemark.operators.ingest import message_text
from tidemark.plans.gate_queries import tokens_sql
from tidemark.plans.record_queries import _MESSAGE
from tidemark.sources.tables import table

TARGET = 60
BUDGET, RESERVE = 120, 20


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").filter("text IS NOT NULL").select("doc_id", "text")


def token_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Heuristic tokens of every document, for two families."""
    return _documents(spark, directory).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.token_estimate(F.col("text"), "openai").alias("quarter"))


def token_families(spark: SparkSession, directory: str) -> DataFrame:
    """The tokenizer family of each model of the spend facts, and of wrapped ids made from it."""
    rows = table(spark, directory, "spend").select("model").distinct().filter("model IS NOT NULL")
    ids = F.explode(F.array("model", F.concat(F.lit("ft:gpt-x:"), "model"), F.concat(F.lit("eu.claude-"), "model"), F.concat(F.lit("o3-"), "model")))
    return rows.select(ids.alias("model")).select("model", tx.family(F.col("model")).alias("family"))


def content_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """The kind of every document."""
    return _documents(spark, directory).select("doc_id", compress.kind(F.col("text")).alias("kind"))


def log_compressed(spark: SparkSession, directory: str) -> DataFrame:
    """Log documents as their patterns."""
    rows = _documents(spark, directory).filter(compress.kind(F.col("text")) == "logs")
    return compress.compress_logs(rows, "doc_id", "text").select("doc_id", F.md5("small").alias("small_md5"), "patterns")


def compress_all(spark: SparkSession, directory: str) -> DataFrame:
    """Every document compressed by its kind, with its reference and what it saves."""
    rows = _documents(spark, directory).withColumn("kind", compress.kind(F.col("text")))
    rows = compress.metrics(rows.withColumn("small", compress.compressed("text", "kind")), "text", "small")
    return rows.select("doc_id", "kind", compress.reference(F.col("text")).alias("ref"), "tokens_before", "tokens_after", "ratio")


def compress_target(spark: SparkSession, directory: str) -> DataFrame:
    """Every document compressed to at most a number of tokens."""
    rows = _documents(spark, directory).withColumn("kind", compress.kind(F.col("text")))
    rows = rows.withColumn("small", compress.compressed("text", "kind", TARGET))
    return rows.select("doc_id", "kind", tx.token_estimate(F.col("small")).alias("tokens"), F.md5("small").alias("small_md5"))


def stored_originals(spark: SparkSession, directory: str) -> DataFrame:
    """The store: each distinct text once."""
    return compress.store(_documents(spark, directory), "text").select("ref", F.length("value").alias("size"))


def expanded_handles(spark: SparkSession, directory: str) -> DataFrame:
    """Handles of every document joined back to their originals."""
    rows = _documents(spark, directory)
    ref = compress.reference(F.col("text"))
    handles = rows.select("doc_id", ref.alias("ref"), compress.handle_id(ref, "extractive").alias("id"))
    out = compress.expand(handles, compress.store(rows, "text"))
    return out.select("doc_id", "id", F.md5("value").alias("value_md5"))


def word_frequencies(spark: SparkSession, directory: str) -> DataFrame:
    """Words of all documents and their counts, without the words that don't count."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)))
    rows = _documents(spark, directory).select(words.alias("word")).filter(~F.col("word").isin(sorted(compress.STOP)))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _messages(spark: SparkSession, directory: str) -> DataFrame:
    """Recorded requests as arrays of messages with string contents, their tokens and a priority."""
    rows = table(spark, directory, "llm").select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    schema = "array<struct<role:string,content:string>>"
    parsed = F.from_json(F.get_json_object("e.request", "$.messages"), schema)
    m = F.transform(
        parsed,
        lambda x, i: F.struct(x.role.alias("role"), F.coalesce(x.content, F.lit("")).alias("content"), ((i * 7) % 5).alias("priority"), (i == 0).alias("pin")),
    )
    return rows.select("cassette_id", "arrived_at", "e.seq", m.alias("messages")).filter("messages IS NOT NULL")


def _tokens(spark: SparkSession, directory: str) -> DataFrame:
    """The estimated tokens of the text of each message of the recorded requests."""
    rows = table(spark, directory, "llm").select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    rows = rows.withColumn("m", F.try_variant_get(strict_json("e.request"), "$.messages", "array<variant>")).filter("m IS NOT NULL")
    return rows.select("cassette_id", "arrived_at", "e.seq", F.transform("m", lambda x: tx.token_estimate(message_text(x))).alias("tokens"))


def pack_history(spark: SparkSession, directory: str) -> DataFrame:
    """How many of the newest messages fit the budget, by the tokens of their texts."""
    rows = _tokens(spark, directory)
    return rows.select("cassette_id", "arrived_at", "seq", packing.kept_history(F.col("tokens"), BUDGET, RESERVE).alias("kept"))


def pack_first_fit(spark: SparkSession, directory: str) -> DataFrame:
    """Which messages fit the budget when tried in order."""
    fit = packing.first_fit(F.col("tokens"), BUDGET, RESERVE)
    rows = _tokens(spark, directory).withColumn("fit", fit)
    return rows.select("cassette_id", "arrived_at", "seq", "fit.used", F.array_join(F.col("fit.kept").cast("array<string>"), ",").alias("kept"))


def _content_tokens(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "llm").select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    rows = rows.withColumn("m", F.try_variant_get(strict_json("e.request"), "$.messages", "array<variant>")).filter("m IS NOT NULL")
    size = F.transform("m", lambda x: packing.content_tokens(F.try_variant_get(x, "$.content", "variant")))
    return rows.select("cassette_id", "arrived_at", "e.seq", size.alias("tokens"))


def pack_history_content(spark: SparkSession, directory: str) -> DataFrame:
    """How many of the newest messages fit the budget, by the tokens of their whole contents, also those that are no text."""
    rows = _content_tokens(spark, directory)
    return rows.select("cassette_id", "arrived_at", "seq", packing.kept_history(F.col("tokens"), BUDGET, RESERVE).alias("kept"))


def pack_first_fit_content(spark: SparkSession, directory: str) -> DataFrame:
    """Which messages fit the budget when tried in order, by the tokens of their whole contents."""
    rows = _content_tokens(spark, directory).withColumn("fit", packing.first_fit(F.col("tokens"), BUDGET, RESERVE))
    return rows.select("cassette_id", "arrived_at", "seq", "fit.used", F.array_join(F.col("fit.kept").cast("array<string>"), ",").alias("kept"))


def pack_assembled(spark: SparkSession, directory: str) -> DataFrame:
    """The recorded requests put together under a budget: system messages are pinned, tools may be compressed, others are truncated."""
    rows = table(spark, directory, "llm").select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    rows = rows.withColumn("m", F.try_variant_get(strict_json("e.request"), "$.messages", "array<variant>")).filter("m IS NOT NULL")
    role = lambda x: F.try_variant_get(x, "$.role", "string")
    one = lambda x, i: F.struct(
        role(x).alias("role"), message_text(x).alias("content"), i.alias("priority"), (role(x) == "system").alias("pin"), F.when(role(x) == "tool", "compress").otherwise("truncate").alias("evict"), F.lit("head").alias("keep"),
        F.lit(0).alias("images"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("turns"),
    )
    rows = rows.select("cassette_id", "arrived_at", "e.seq", F.transform("m", one).alias("blocks")).withColumn("a", assembly.assembled("blocks", BUDGET, RESERVE))
    receipt = F.array_join(F.transform("a.decisions", lambda d: F.concat_ws(":", d.role, d.action, d.after.cast("string"))), ",")
    return rows.select("cassette_id", "arrived_at", "seq", "a.used", "a.overflow", receipt.alias("receipt"))


def pack_orders(spark: SparkSession, directory: str) -> DataFrame:
    """The roles of each request in the three message orders and in packing order."""
    roles = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m.role, m.priority.cast("string"))), ",")
    m = F.col("messages")
    return _messages(spark, directory).select(
        "cassette_id",
        "arrived_at",
        "seq",
        roles(packing.message_order(m)).alias("by_default"),
        roles(packing.message_order(m, "attention")).alias("by_attention"),
        roles(packing.message_order(m, "cache")).alias("by_cache"),
        roles(packing.block_order(m)).alias("by_block"),
    )


def pack_providers(spark: SparkSession, directory: str) -> DataFrame:
    """System text apart and provider roles."""
    rows = _messages(spark, directory).withColumn("s", packing.split_system(F.col("messages")))
    roles = F.array_join(F.transform(packing.provider_roles(F.col("s.messages"), "gemini"), lambda m: m.role), ",")
    return rows.select("cassette_id", "arrived_at", "seq", F.col("s.system").alias("system"), roles.alias("roles"))


QUERIES = {
    "token_counts": token_counts,
    "token_families": token_families,
    "content_kinds": content_kinds,
    "log_compressed": log_compressed,
    "compress_all": compress_all,
    "compress_target": compress_target,
    "stored_originals": stored_originals,
    "expanded_handles": expanded_handles,
    "word_frequencies": word_frequencies,
    "pack_history": pack_history,
    "pack_first_fit": pack_first_fit,
    "pack_history_content": pack_history_content,
    "pack_first_fit_content": pack_first_fit_content,
    "pack_assembled": pack_assembled,
    "pack_orders": pack_orders,
    "pack_providers": pack_providers,
}

_SP = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_STRIP = f"regexp_replace({{t}}, '^{_SP}+|{_SP}+$', '', 'g')".replace("{{t}}", "{t}")


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_SP}+|{_SP}+$', '', 'g')"


def _lines(t: str) -> str:
    parts = f"string_split_regex({t}, '{_END}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


_MARK = "|".join(m.replace("#", "\\#") for m in compress.CODE_MARKERS)
_KIND = f"""kinds AS (SELECT doc_id, text, CASE WHEN s = '' THEN 'prose' WHEN regexp_matches(s, '^[{{\\[]') AND json_valid(s) THEN 'json'
    WHEN len(rows) >= 3 AND len(list_filter(rows, lambda x: regexp_matches(x, '{compress.STAMP}') OR regexp_matches(x, '{compress.LEVEL}'))) >= len(rows) * 0.5 THEN 'logs'
    WHEN len(list_filter(rows, lambda x: regexp_matches(x, '{_MARK}') OR regexp_matches({_strip('x')}, '[{{}};:]$'))) >= greatest(1, len(rows) * 0.3) THEN 'code' ELSE 'prose' END AS kind
  FROM (SELECT doc_id, text, s, list_filter({_lines('s')}, lambda x: {_strip('x')} <> '') AS rows FROM (SELECT doc_id, text, {_strip('text')} AS s FROM documents WHERE text IS NOT NULL)))"""
_MASKED = "line"
for _source, _mask in compress.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_source}', '{_mask}', 'g')"
_MSG = """msg AS (SELECT cassette_id, arrived_at, e.seq AS seq, list_transform(from_json(json_extract(e.request, '$.messages'), '["JSON"]'), lambda m, i:
    {'role': json_extract_string(m, '$.role'), 'tokens': __TOKENS__, 'content': coalesce(json_extract_string(m, '$.content'), ''), 'priority': ((i - 1) * 7) % 5, 'pin': i = 1, 'i': i - 1}) AS m
  FROM (SELECT cassette_id, arrived_at, unnest(entries) AS e FROM llm) WHERE json_valid(e.request) AND json_type(e.request, '$.messages') = 'ARRAY')"""
_MSG = _MSG.replace("__TOKENS__", tokens_sql(f"({_MESSAGE})"))
_ROLES = "array_to_string(list_transform({x}, lambda k: k.m.role || k.m.priority), ',')"
_ROOM = BUDGET - RESERVE


def _sorted(where: str, *keys: str) -> str:
    fields = ", ".join(f"'k{n}': {k}" for n, k in enumerate(keys))
    return f"list_sort(list_transform(list_filter(m, lambda x: {where}), lambda x: {{{fields}, 'i': x.i, 'm': x}}))"


_MIDDLE = _sorted("x.role NOT IN ('system', 'user')", "-x.priority")
SQL = {
    "token_counts": f"SELECT doc_id, {tokens_sql('text')} AS tokens, CAST(ceil(len(text) / 4.0::DOUBLE) AS BIGINT) AS quarter FROM documents WHERE text IS NOT NULL",
    "token_families": """SELECT m AS model, CASE WHEN regexp_matches(b, '^(gpt|chatgpt|text-|davinci|o\\d)') THEN 'openai' WHEN contains(b, 'claude') THEN 'anthropic' WHEN contains(b, 'gemini') THEN 'google' ELSE 'default' END AS family
      FROM (SELECT m, lower(CASE WHEN starts_with(lower(m), 'ft:') AND split_part(m, ':', 2) <> '' THEN split_part(m, ':', 2) ELSE m END) AS b
      FROM (SELECT unnest([model, 'ft:gpt-x:' || model, 'eu.claude-' || model, 'o3-' || model]) AS m FROM (SELECT DISTINCT model FROM spend WHERE model IS NOT NULL)))""",
    "content_kinds": f"WITH {_KIND} SELECT doc_id, kind FROM kinds",
    "log_compressed": f"""WITH {_KIND}, line AS (SELECT doc_id, unnest(rows) AS line, unnest(range(len(rows))) AS pos FROM (SELECT doc_id, {_lines('text')} AS rows FROM kinds WHERE kind = 'logs')),
      pattern AS (SELECT doc_id, {_MASKED} AS p, count(*) AS n, min(pos) AS first FROM line GROUP BY ALL)
      SELECT doc_id, md5(string_agg(CASE WHEN n > 1 THEN p || ' (×' || n || ')' ELSE p END, chr(10) ORDER BY first)) AS small_md5, CAST(count(*) AS INT) AS patterns FROM pattern GROUP BY doc_id""",
    "stored_originals": "SELECT DISTINCT sha256(text) AS ref, len(text) AS size FROM documents WHERE text IS NOT NULL",
    "expanded_handles": "SELECT doc_id, sha256(sha256(text) || ':extractive')[:32] AS id, md5(text) AS value_md5 FROM documents WHERE text IS NOT NULL",
    "word_frequencies": f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents)
      WHERE word NOT IN ({", ".join(repr(w) for w in sorted(compress.STOP))}) GROUP BY word""",
    "pack_history": f"""WITH {_MSG}, turn AS (SELECT cassette_id, arrived_at, seq, unnest(m) AS x FROM msg),
      cost AS (SELECT *, sum(x.tokens + 4) OVER (PARTITION BY cassette_id, arrived_at, seq ORDER BY x.i DESC) + 3 AS used FROM turn)
      SELECT m.cassette_id, m.arrived_at, m.seq, CAST(count(*) FILTER (c.used <= {_ROOM}) AS INT) AS kept FROM msg m LEFT JOIN cost c USING (cassette_id, arrived_at, seq) GROUP BY ALL""",
    "pack_first_fit": f"""WITH {_MSG}, fit AS (SELECT cassette_id, arrived_at, seq, list_reduce(list_transform(m, lambda x: {{'used': CAST(x.tokens AS BIGINT), 'kept': CAST([x.i] AS BIGINT[])}}),
        lambda a, x: CASE WHEN a.used + CASE WHEN len(a.kept) = 0 THEN 3 ELSE 0 END + 4 + x.used <= {_ROOM}
          THEN {{'used': a.used + CASE WHEN len(a.kept) = 0 THEN 3 ELSE 0 END + 4 + x.used, 'kept': list_concat(a.kept, x.kept)}} ELSE a END, {{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[])}}) AS f FROM msg)
      SELECT cassette_id, arrived_at, seq, f.used AS used, array_to_string(f.kept, ',') AS kept FROM fit""",
    "pack_orders": f"""WITH {_MSG} SELECT cassette_id, arrived_at, seq,
      {_ROLES.format(x=_sorted("true", "CASE x.role WHEN 'system' THEN 0 WHEN 'assistant' THEN 2 WHEN 'user' THEN 3 ELSE 1 END"))} AS by_default,
      array_to_string(list_filter([nullif({_ROLES.format(x=_sorted("x.role = 'system'", "-x.priority"))}, ''),
        nullif({_ROLES.format(x=f"list_concat(list_filter({_MIDDLE}, lambda x, j: j % 2 = 1), list_reverse(list_filter({_MIDDLE}, lambda x, j: j % 2 = 0)))")}, ''),
        nullif({_ROLES.format(x=_sorted("x.role = 'user'", "x.priority"))}, '')], lambda x: x IS NOT NULL), ',') AS by_attention,
      {_ROLES.format(x=_sorted("true", "NOT x.pin", "-x.priority"))} AS by_cache, {_ROLES.format(x=_sorted("true", "NOT x.pin", "-x.priority"))} AS by_block FROM msg""",
    "pack_providers": f"""WITH {_MSG} SELECT cassette_id, arrived_at, seq, array_to_string(list_transform(list_filter(m, lambda x: x.role = 'system'), lambda x: x.content), chr(10) || chr(10)) AS system,
      array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: CASE WHEN x.role = 'assistant' THEN 'model' ELSE 'user' END), ',') AS roles FROM msg""",
}
