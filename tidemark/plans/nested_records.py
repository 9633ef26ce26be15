"""Queries of problem 1: nested chain lines and cassette entries as flat tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import nested
from tidemark.sources.recordings import cassette_records, chain_records
from tidemark.sources.tables import table
from tidemark.storage import written

CHAIN_TEXTS = {"$": "doc"}
LLM_TEXTS = {"$.request": "request", "$.response": "response"}


def chain_nodes(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(merged schema, nodes) of the chain lines."""
    lines = table(spark, directory, "chain_signed")
    schema = nested.merged_schema(lines.select(F.lit("chain_signed").alias("tbl"), F.col("line").alias("doc")), CHAIN_TEXTS)
    return schema, nested.nodes(chain_records(lines, parsed=True), CHAIN_TEXTS, nested.depth(schema))


def llm_nodes(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(merged schema, nodes) of the cassette entries."""
    cassettes = table(spark, directory, "llm")
    entries = cassettes.select(F.lit("llm").alias("tbl"), F.explode("entries").alias("e")).select("tbl", "e.request", "e.response")
    schema = nested.merged_schema(entries, LLM_TEXTS)
    return schema, nested.nodes(cassette_records(cassettes), LLM_TEXTS, nested.depth(schema))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every JSON object below a record with its nearest enclosing object."""
    found = [nodes.filter("kind = 'object'") for _, nodes in (chain_nodes(spark, directory), llm_nodes(spark, directory))]
    both = found[0].unionByName(found[1])
    return both.select("tbl", "record_id", F.col("owner").alias("parent_path"), F.col("path").alias("child_path"))


def p1_schema(spark: SparkSession, directory: str) -> DataFrame:
    """The merged schema of both tables over the records as delivered once."""
    chain = nested.merged_schema(chain_records(table(spark, directory, "chain_signed")), CHAIN_TEXTS)
    llm = nested.merged_schema(cassette_records(table(spark, directory, "llm")), LLM_TEXTS)
    return chain.unionByName(llm)


def _child(nodes: tuple[DataFrame, DataFrame], tbl: str, template: str) -> DataFrame:
    """The child table of a path with the columns that the merged schema has for it."""
    schema, rows = nodes
    return nested.child_table(rows, tbl, template, nested.columns_of(written(schema, "schema"), tbl, template))


def p1_usage(spark: SparkSession, directory: str) -> DataFrame:
    """The child table of ``payload.usage``."""
    return _child(chain_nodes(spark, directory), "chain_signed", "$.payload.usage")


def p1_summary(spark: SparkSession, directory: str) -> DataFrame:
    """The child table of ``_meta.summary``."""
    return _child(chain_nodes(spark, directory), "chain_signed", "$._meta.summary")


def p1_messages(spark: SparkSession, directory: str) -> DataFrame:
    """The child table of ``request.messages``; ``content`` is null where it is a list with a table of its own."""
    return _child(llm_nodes(spark, directory), "llm", "$.request.messages[]")


def p1_content_parts(spark: SparkSession, directory: str) -> DataFrame:
    """The child table of ``request.messages.content`` where it is a list of parts."""
    return _child(llm_nodes(spark, directory), "llm", "$.request.messages[].content[]")


def p1_functions(spark: SparkSession, directory: str) -> DataFrame:
    """The child table of the functions that ``request.messages.tool_calls`` call."""
    return _child(llm_nodes(spark, directory), "llm", "$.request.messages[].tool_calls[].function")


def p1_tables(spark: SparkSession, directory: str) -> DataFrame:
    """Every child table of every path of both tables: its rows, the parents that they point to and the values in its columns."""
    lines, cassettes = table(spark, directory, "chain_signed"), table(spark, directory, "llm")
    parts = []
    for records, texts in ((chain_records(lines, parsed=True), CHAIN_TEXTS), (cassette_records(cassettes), LLM_TEXTS)):
        docs = chain_records(lines) if texts is CHAIN_TEXTS else records
        schema = written(nested.merged_schema(docs, texts), "schema")
        tables = nested.child_tables(nested.nodes(records, texts, nested.depth(schema), roots=True), schema)
        for (tbl, template), rows in tables.items():
            keys, columns = rows.columns[:4], rows.columns[4:]
            values = [F.count(F.col(f"`{c}`")) for c in columns]
            parts.append(rows.select(F.lit(tbl).alias("tbl"), F.lit(template).alias("template"), F.col(keys[2]).alias("parent_key"), *columns).groupBy("tbl", "template").agg(
                F.count(F.lit(1)).alias("rows"), F.countDistinct("parent_key").alias("parents"), sum(values, F.lit(0)).cast("long").alias("values")
            ))
    return functools.reduce(DataFrame.unionByName, parts)


def p1_members(spark: SparkSession, directory: str) -> DataFrame:
    """Every object, list and scalar of every path of both tables, with columns of the merged schema, as one long related table."""
    lines, cassettes = table(spark, directory, "chain_signed"), table(spark, directory, "llm")
    chain, llm = chain_records(lines, parsed=True), cassette_records(cassettes)
    chain_schema = written(nested.merged_schema(lines.select(F.lit("chain_signed").alias("tbl"), F.col("line").alias("doc")), CHAIN_TEXTS), "schema")
    entries = cassettes.select(F.lit("llm").alias("tbl"), F.explode("entries").alias("e")).select("tbl", "e.request", "e.response")
    llm_schema = written(nested.merged_schema(entries, LLM_TEXTS), "schema")
    parts = [
        nested.members(nested.nodes(records, texts, nested.depth(schema), roots=True), schema)
        for records, texts, schema in ((chain, CHAIN_TEXTS, chain_schema), (llm, LLM_TEXTS, llm_schema))
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {
    "p1_found": p1_found,
    "p1_members": p1_members,
    "p1_schema": p1_schema,
    "p1_usage": p1_usage,
    "p1_summary": p1_summary,
    "p1_messages": p1_messages,
    "p1_content_parts": p1_content_parts,
    "p1_functions": p1_functions,
    "p1_tables": p1_tables,
}

_CHAIN = """chain AS (
  SELECT record_id, arg_min(line, line_no) AS doc FROM (
    SELECT coalesce(chain_id, '') || '/' || CASE WHEN json_exists(line, '$._meta') THEN 'meta'
             ELSE coalesce(json_extract_string(line, '$.seq'), 'line' || line_no) END AS record_id, line, line_no
    FROM chain_signed WHERE line IS NOT NULL AND json_valid(line)) GROUP BY 1)"""
_LLM = """entry AS (SELECT coalesce(cassette_id, '') || '/' || e.seq AS record_id, e, arrived_at
    FROM (SELECT cassette_id, arrived_at, unnest(entries) AS e FROM llm)),
  once AS (SELECT record_id, arg_min(e, arrived_at) AS e FROM entry GROUP BY 1),
  part AS (SELECT record_id, '$.request' AS root, e.request AS doc FROM once WHERE json_valid(e.request)
    UNION ALL SELECT record_id, '$.response', e.response FROM once WHERE json_valid(e.response))"""
_OWNER = r"""regexp_replace({p}, '\.("[^"]*"|[^.\[]+)(\[\d+\])*$', '')"""
_KEY = "md5('{t}' || chr(31) || record_id || chr(31) || {p})"
_PLAIN = r"""regexp_replace(t.fullkey, '"(\w+)"', '\1', 'g')"""
_CHAIN_TREE = f"tree AS (SELECT record_id, {_PLAIN} AS p, t.type AS kind, t.value FROM chain, json_tree(chain.doc) t)"
_LLM_TREE = f"tree AS (SELECT record_id, part.root || substr({_PLAIN}, 2) AS p, t.type AS kind, t.value FROM part, json_tree(part.doc) t)"
_KINDS = "CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'double' ELSE 'integer' END"


def _child_sql(table_name: str, ctes: str, where: str, columns: str, ordinal: str = "CAST(NULL AS INT)") -> str:
    return f"""WITH {ctes} SELECT record_id, {_KEY.format(t=table_name, p='p')} AS node_key,
      {_KEY.format(t=table_name, p=_OWNER.format(p='p'))} AS parent_key, {ordinal} AS ordinal, {columns}
    FROM tree WHERE kind = 'OBJECT' AND {where}"""


_PARENT = r"regexp_replace(p, '(\.[^.\[]+|\[\d+\])$', '')"
_TEMPLATE = r"regexp_replace({p}, '\[\d+\]', '[]', 'g')"


def _tables(name: str, ctes: str) -> str:
    """Rows, parents and values of each child table of one of the two trees."""
    return f"""SELECT tbl, template, count(*) FILTER (own) AS rows, count(DISTINCT CASE WHEN own AND p <> '$' THEN record_id || owner END) AS parents, count(*) FILTER (NOT own) AS values FROM (
      WITH {ctes} SELECT '{name}' AS tbl, record_id, p, {_OWNER.format(p='p')} AS owner, kind = 'OBJECT' AS own, CASE WHEN kind = 'OBJECT' THEN {_TEMPLATE.format(p='p')} ELSE {_TEMPLATE.format(p=_PARENT)} END AS template
      FROM tree WHERE kind = 'OBJECT' OR kind NOT IN ('OBJECT', 'ARRAY', 'NULL') AND regexp_matches(p, '\\.[^.\\[]+$')) WHERE template <> '$' OR own OR tbl = 'chain_signed' GROUP BY ALL"""


SQL = {
    "p1_tables": f"""{_tables('chain_signed', f'{_CHAIN}, {_CHAIN_TREE}')} UNION ALL {_tables('llm', f'{_LLM}, {_LLM_TREE}')}""",
    "p1_functions": _child_sql(
        "llm",
        f"{_LLM}, {_LLM_TREE}",
        r"regexp_full_match(p, '\$\.request\.messages\[\d+\]\.tool_calls\[\d+\]\.function')",
        "json_extract_string(value, '$.name') AS name, json_extract_string(value, '$.arguments') AS arguments",
    ),
    "p1_found": f"""SELECT 'chain_signed' AS tbl, record_id, {_OWNER.format(p='p')} AS parent_path, p AS child_path
    FROM (WITH {_CHAIN}, {_CHAIN_TREE} SELECT * FROM tree) WHERE kind = 'OBJECT' AND p <> '$'
    UNION ALL SELECT 'llm', record_id, {_OWNER.format(p='p')}, p
    FROM (WITH {_LLM}, {_LLM_TREE} SELECT * FROM tree) WHERE kind = 'OBJECT'""",
    "p1_schema": f"""SELECT tbl, path, kind, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT 'chain_signed' AS tbl, regexp_replace(p, '\\[\\d+\\]', '[]', 'g') AS path, {_KINDS} AS kind
      FROM (WITH {_CHAIN}, {_CHAIN_TREE} SELECT * FROM tree)
      UNION ALL SELECT 'llm', regexp_replace(p, '\\[\\d+\\]', '[]', 'g'), {_KINDS}
      FROM (WITH {_LLM}, {_LLM_TREE} SELECT * FROM tree)) GROUP BY ALL""",
    "p1_usage": _child_sql(
        "chain_signed",
        f"{_CHAIN}, {_CHAIN_TREE}",
        "p = '$.payload.usage'",
        ", ".join(f"TRY_CAST(json_extract_string(value, '$.{c}') AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_write")),
    ),
    "p1_summary": _child_sql(
        "chain_signed",
        f"{_CHAIN}, {_CHAIN_TREE}",
        "p = '$._meta.summary'",
        ", ".join(f"TRY_CAST(json_extract_string(value, '$.{c}') AS BIGINT) AS {c}" for c in ("decisions", "llm_calls", "tool_calls")),
    ),
    "p1_messages": _child_sql(
        "llm",
        f"{_LLM}, {_LLM_TREE}",
        r"regexp_full_match(p, '\$\.request\.messages\[\d+\]')",
        "json_extract_string(value, '$.role') AS role, CASE WHEN json_type(value, '$.content') = 'VARCHAR' THEN json_extract_string(value, '$.content') END AS content, json_extract_string(value, '$.tool_call_id') AS tool_call_id",
        r"CAST(regexp_extract(p, '\[(\d+)\]$', 1) AS INT)",
    ),
    "p1_content_parts": _child_sql(
        "llm",
        f"{_LLM}, {_LLM_TREE}",
        r"regexp_full_match(p, '\$\.request\.messages\[\d+\]\.content\[\d+\]')",
        "json_extract_string(value, '$.type') AS type, json_extract_string(value, '$.text') AS text",
        r"CAST(regexp_extract(p, '\[(\d+)\]$', 1) AS INT)",
    ),
}
