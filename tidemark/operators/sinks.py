"""Writing and bounding what is kept: spend rows, content stores, captured content, spans of external models.

Defined results: null texts stay null; a capture of more bytes than allowed ends in a marker; overlapping spans are one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered

MARKER = "…[truncated]"
WITHHELD = "[mask failed; content withheld]"
#: So many rows are kept by a top-k that meets in one task; more are numbered in order.
TOP_ROWS = 10_000


def spend_rows(spend: DataFrame) -> DataFrame:
    """Spend facts as an append-only table keeps them: usd as text, tags as JSON with sorted keys."""
    tags = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags"))))
    return spend.select("spend_id", "ts", "model", F.col("usd").cast("string").alias("usd"), tags.alias("tags"), "input_tokens", "output_tokens", "reasoning_tokens", "calls")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def add_missing(store: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` (ref, value) whose ref isn't in the store yet, each once."""
    return new.dropDuplicates(["ref"]).join(store.select("ref"), "ref", "left_anti")


def recently_used(uses: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` refs that were used last, of (ref, at); ties by ref."""
    last = uses.groupBy("ref").agg(F.max("at").alias("at"))
    order = [F.col("at").desc(), F.col("ref")]
    if keep <= TOP_ROWS:  # every task keeps only its own last ones
        return last.orderBy(*order).limit(keep)
    return ordered.positions(last, None, order, "recent").filter(F.col("position") < keep).select("ref", "at")


def captured(text: Column, max_bytes: int = 8192) -> Column:
    """The text if its UTF-8 form has at most ``max_bytes`` bytes, else that many bytes of it and a marker."""
    raw = F.encode(text, "UTF-8")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, max_bytes).cast("string")), "�+$", "")
    return F.when(F.length(raw) > max_bytes, F.concat(cut, F.lit(MARKER))).otherwise(text)


def masked_capture(text: Column | str, mask: Callable[[str], str], max_bytes: int = 8192) -> Column:
    """The text after ``mask`` and cut to ``max_bytes``; where the mask fails the content is withheld, never shown as it was."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: object) -> str | None:
            try:
                return mask(t) if isinstance(t, str) else None
            except Exception:  # noqa: BLE001
                return WITHHELD

        return pd.Series([one(t) for t in texts], dtype=object)

    return captured(run(text), max_bytes)


def without_spans(text: Column | str, spans: Column | str, by: str = "<redacted>") -> Column:
    """The text with the spans ARRAY<STRUCT<begin, end>> of any model replaced; overlapping and touching spans are one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: object, rows: object) -> str | None:
            if not isinstance(t, str) or rows is None:
                return t if isinstance(t, str) else None
            merged: list[list[int]] = []
            for begin, end in sorted((r["begin"], r["end"]) for r in rows if r["end"] > r["begin"]):
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
            for begin, end in reversed(merged):
                t = t[:begin] + by + t[end:]
            return t

        return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)], dtype=object)

    return run(text, spans)
