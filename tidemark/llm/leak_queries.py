"""Queries of problem 6: evaluation passages in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.leaks import SPAN, leaks
from tidemark.sources.tables import table


def _leaks(spark: SparkSession, directory: str) -> DataFrame:
    return leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with at least ten consecutive words of an item's passage."""
    return _leaks(spark, directory).select("doc_id", "item_id")


def p6_items(spark: SparkSession, directory: str) -> DataFrame:
    """How many documents each leaked item stands in."""
    found = _leaks(spark, directory)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p6_found": p6_found, "p6_items": p6_items}

_LEAKS = f"""WITH word AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
  item AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
  doc_run AS (SELECT doc_id, array_to_string(w[i:i + {SPAN - 1}], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM word)),
  item_run AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {SPAN - 1}], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM item)),
  found AS (SELECT DISTINCT doc_id, item_id FROM doc_run JOIN item_run USING (run))"""
SQL = {
    "p6_found": f"{_LEAKS} SELECT doc_id, item_id FROM found",
    "p6_items": f"{_LEAKS} SELECT item_id, count(*) AS documents FROM found GROUP BY item_id",
}
