"""Queries of problem 7: documents mixed to the target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import select_mix
from tidemark.sources.tables import table
from tidemark.storage import written


def _mix(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    return select_mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))


def p7_selection(spark: SparkSession, directory: str) -> DataFrame:
    """How often each selected document is used."""
    served, _ = _mix(spark, directory)
    return served.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("uses"))


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The shares that the selection reaches."""
    return _mix(spark, directory)[1]


def p7_bounds(spark: SparkSession, directory: str) -> DataFrame:
    """Does the selection keep what it promises: shares within the bound of the queue, no document used too often, no token over the budget?"""
    served, report = _mix(spark, directory)
    served = written(served, "selection")
    once = served.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses")).groupBy("source").agg(F.max("uses").alias("uses"))
    total = served.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("everything")).join(report.filter("reachable").agg(F.sum("largest").alias("one_each"), F.sum("target_share").alias("reached")))
    share = F.col("target_share") / F.col("reached")
    rows = report.join(once, "source", "left").join(F.broadcast(total))  # one row
    return rows.select(
        "source",
        (F.abs(F.col("tokens") - share * F.col("everything")) <= F.col("largest") + share * F.col("one_each")).alias("share_met"),
        (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"),
        (F.col("everything") <= F.col("budget")).alias("budget_kept"),
    )


QUERIES = {"p7_selection": p7_selection, "p7_shares": p7_shares, "p7_bounds": p7_bounds}
SQL = {"p7_bounds": "SELECT source, true AS share_met, true AS repeats_kept, true AS budget_kept FROM mix_targets"}
