"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.shipping import ensure_shipped


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The rows of ``<directory>/<name>.parquet``; filters and columns are pushed into the scan."""
    return ensure_shipped(spark).read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
