"""Queries of problem 2: personal data in the detector and scrubber cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.personal import detect, known_names
from tidemark.sources.tables import table


def _texts(spark: SparkSession, directory: str) -> DataFrame:
    """(tbl, fld, case_id, text): each case once, with the texts that arrived first."""

    def once(name: str, fields: list[str]) -> DataFrame:
        rows = table(spark, directory, name).filter("case_id IS NOT NULL").select("case_id", F.struct("arrived_at", *fields).alias("d"))
        rows = rows.groupBy("case_id").agg(F.min("d").alias("d"))
        texts = F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f"d.{f}").alias("text")) for f in fields)))
        return rows.select(F.lit(name).alias("tbl"), "case_id", texts.alias("t")).select("tbl", "t.fld", "case_id", "t.text")

    return once("detect", ["input", "redacted"]).unionByName(once("redaction", ["input"]))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every occurrence of personal data, numbered per kind in reading order."""
    names = known_names(table(spark, directory, "known_names"))
    rows = _texts(spark, directory).filter("text IS NOT NULL").withColumn("d", detect("text", names))
    rows = rows.select("tbl", "fld", "case_id", F.explode("d.found").alias("f"))
    return rows.select("tbl", "fld", "case_id", "f.kind", "f.ord")


def p2_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """Every text with typed placeholders instead of personal data."""
    names = known_names(table(spark, directory, "known_names"))
    return _texts(spark, directory).withColumn("d", detect("text", names)).select("tbl", "fld", "case_id", F.col("d.redacted").alias("text"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
