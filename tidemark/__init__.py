"""Tidemark: analytics over LLM application data, written for Spark DataFrames."""

__version__ = "0.1.0"
