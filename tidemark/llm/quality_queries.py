"""Queries of problem 8: text statistics of the documents and their shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import quality
from tidemark.sources.tables import table


def p8_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """The five statistics of every document."""
    common = quality.common_word_list(table(spark, directory, "common_words"))
    rows = quality.statistics(table(spark, directory, "documents"), common)
    return rows.select("doc_id", *quality.STATISTICS)


def p8_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """The shape of every document and how sure the mixture is of it."""
    common = quality.common_word_list(table(spark, directory, "common_words"))
    return quality.document_shapes(table(spark, directory, "documents"), common)


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """The documents that aren't natural prose as a whole."""
    return p8_shapes(spark, directory).filter("shape <> 'prose'").select("doc_id", "shape")


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics, "p8_shapes": p8_shapes}

_BLANK = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL = {
    "p8_statistics": rf"""WITH doc AS (SELECT doc_id, text IS NOT NULL AS known, list_filter(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '') AS lines,
      regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') AS words, regexp_replace(text, '{_BLANK}', '', 'g') AS seen FROM documents)
    SELECT doc_id, CASE WHEN known THEN len(words) END AS word_count, CASE WHEN known THEN len(array_to_string(words, '')) / nullif(len(words), 0)::DOUBLE END AS mean_word_length,
      CASE WHEN known THEN len(regexp_replace(seen, '[\p{{L}}\p{{N}}\p{{M}}]', '', 'g')) / nullif(len(seen), 0)::DOUBLE END AS symbol_ratio,
      CASE WHEN known THEN len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…]["”»’'')\]]*{_BLANK}*$'))) / nullif(len(lines), 0)::DOUBLE END AS punctuated_lines,
      CASE WHEN known THEN len(list_filter(words, lambda w: list_contains(common, lower(w)))) / nullif(len(words), 0)::DOUBLE END AS common_words FROM doc, (SELECT list(DISTINCT lower(word)) AS common FROM common_words)""",
}
