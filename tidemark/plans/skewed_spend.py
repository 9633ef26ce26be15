"""Queries of problem 5: totals per model, feature and user of the spend facts."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunks
from tidemark.sources.tables import table

KEYS = ("model", "feature", "user_id")
#: A key value with at least this share of all rows is a hot key.
HOT_SHARE = 0.02


def _keyed(spark: SparkSession, directory: str) -> DataFrame:
    """The spend facts with their three keys and their measures."""
    return table(spark, directory, "spend").select(
        "model",
        F.try_element_at("tags", F.lit("feature")).alias("feature"),
        F.try_element_at("tags", F.lit("user_id")).alias("user_id"),
        "usd",
        (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
        "ts",
    )


def spend_keys(spark: SparkSession, directory: str) -> chunks.Numbered:
    """The spend facts numbered per key."""
    return chunks.numbered(_keyed(spark, directory), list(KEYS), name="spend")


def _totals(rows: chunks.Numbered, key: str) -> DataFrame:
    states = {
        "c_rows": F.count(F.lit(1)),
        "c_tokens": F.sum("tokens"),
        "c_usd": F.sum("usd"),
        "c_first": F.min("ts"),
        "c_last": F.max("ts"),
    }
    merges = {
        "rows": F.sum("c_rows"),
        "tokens": F.coalesce(F.sum("c_tokens"), F.lit(0)),
        "usd": F.coalesce(F.sum("c_usd"), F.lit(0)).cast("decimal(38,9)"),
        "first_ts": F.min("c_first"),
        "last_ts": F.max("c_last"),
    }
    merged = chunks.totals(rows, key, states, merges)
    return merged.select(F.lit(key).alias("key_kind"), F.col(key).alias("key_value"), *merges)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _all_totals(rows: chunks.Numbered) -> DataFrame:
    return _union(_totals(rows, key) for key in KEYS)


def p5_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, tokens, usd and time span of each key value; null stands for rows without the key."""
    return _all_totals(spend_keys(spark, directory))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Key values that stand in at least 2 % of all rows, by the totals of the chunked operator."""
    rows = spend_keys(spark, directory)
    least = HOT_SHARE * rows.rows.count()
    hot = _all_totals(rows).filter(F.col("key_value").isNotNull() & (F.col("rows") >= F.lit(least)))
    return hot.select("key_kind", "key_value")


def p5_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """The longest time between two calls of each key value that follow each other: boundary states merged in the order of time."""
    rows = _keyed(spark, directory).filter("ts IS NOT NULL").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select(*KEYS, "at")
    rows = chunks.numbered(rows.repartitionByRange("at").sortWithinPartitions("at"), list(KEYS), name="spend-by-time", counted=rows)
    gaps = lambda key: chunks.longest_gaps(rows, key, "at").select(F.lit(key).alias("key_kind"), F.col(key).alias("key_value"), "rows", "gap")
    return _union(map(gaps, KEYS))


QUERIES = {"p5_found": p5_found, "p5_totals": p5_totals, "p5_gaps": p5_gaps}

_KEYED = """SELECT 'model' AS key_kind, model AS key_value, * FROM spend
    UNION ALL SELECT 'feature', tags['feature'], * FROM spend
    UNION ALL SELECT 'user_id', tags['user_id'], * FROM spend"""
SQL = {
    "p5_found": f"""SELECT key_kind, key_value FROM ({_KEYED}) WHERE key_value IS NOT NULL GROUP BY ALL
    HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM spend)""",
    "p5_totals": f"""SELECT key_kind, key_value, CAST(count(*) AS BIGINT) AS rows,
      CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens,
      CAST(coalesce(sum(usd), 0) AS DECIMAL(38,9)) AS usd, min(ts) AS first_ts, max(ts) AS last_ts
    FROM ({_KEYED}) GROUP BY ALL""",
    "p5_gaps": f"""SELECT key_kind, key_value, count(*) AS rows, max(gap) AS gap FROM (SELECT key_kind, key_value,
      epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key_kind, key_value ORDER BY ts) AS gap FROM ({_KEYED}) WHERE ts IS NOT NULL) GROUP BY ALL""",
}
