"""Record and replay keyed by the hash of a request.

Defined results: null or unreadable requests have no hash; a live request without a recording is reported as
missing; the n-th live occurrence of a hash meets the n-th recorded one, in order.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json import strict_json
from tidemark.operators import ingest, ordered
from tidemark.operators.ledger import canonical, canonical_text
from tidemark.operators.similarity import lexical_score


def request_hash(request: Column | str, version: Column | str) -> Column:
    """SHA-256 of the canonical request; version 1 leaves ``stream`` out, a tool's arguments get the shape {args, kwargs}."""

    @F.pandas_udf("string")
    def run(requests: pd.Series, versions: pd.Series) -> pd.Series:
        return pd.Series([_hash(r, v) for r, v in zip(requests, versions, strict=True)], dtype=object)

    return run(request, version)


def _hash(text: object, version: object) -> str | None:
    try:
        value = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    if isinstance(value, dict):
        if value.get("kind") == "tool":
            value = value | {"arguments": tool_arguments(value.get("arguments"))}
        elif version == 1:
            value.pop("stream", None)
    return hashlib.sha256(canonical_text(value).encode("utf-8", "surrogatepass")).hexdigest()


def tool_arguments(value: object) -> dict:
    """Arguments as {args, kwargs}, whatever form they were given in."""
    if isinstance(value, dict):
        if "args" in value or "kwargs" in value:
            return {"args": value.get("args", []), "kwargs": value.get("kwargs", {})}
        return {"args": [], "kwargs": value}
    return {"args": value if isinstance(value, list) else [value], "kwargs": {}}


def match(recorded: DataFrame, live: DataFrame, order: list[str]) -> DataFrame:
    """Live requests (request_hash and ``order``) with the recording they meet (rec_<order>), ``found`` false where there is none."""
    left = ordered.positions(live, "request_hash", [F.col(c) for c in order], "live")
    right = ordered.positions(recorded, "request_hash", [F.col(c) for c in order], "recorded")
    right = right.select(F.col("request_hash").alias("h"), F.col("position").alias("p"), *(F.col(c).alias(f"rec_{c}") for c in order))
    out = left.join(right, (F.col("request_hash") == F.col("h")) & (F.col("position") == F.col("p")), "left")
    return out.withColumn("found", F.col("h").isNotNull()).drop("h", "p")


def drift(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """(request_hash, changed): live responses that differ from the recorded one in more than their writing."""
    one = recorded.groupBy("request_hash").agg(F.min_by("response", "at").alias("was"))
    now = live.groupBy("request_hash").agg(F.max_by("response", "at").alias("now"))
    both = one.join(now, "request_hash")
    return both.select("request_hash", (~canonical("was").eqNullSafe(canonical("now"))).alias("changed"))


def semantic_drift(recorded: DataFrame, live: DataFrame, least: float = 0.8) -> DataFrame:
    """(request_hash, score): requests whose live answer says something else than the recorded one: a lexical score below ``least``.

    The answers' texts are compared, not their JSON; a missing text counts as an empty one.
    """
    was = recorded.groupBy("request_hash").agg(F.min_by("response", "at").alias("was"))
    now = live.groupBy("request_hash").agg(F.max_by("response", "at").alias("now"))
    said = lambda c: F.coalesce(ingest.text(F.col(c)), F.lit(""))
    return was.join(now, "request_hash").select("request_hash", lexical_score(said("now"), said("was")).alias("score")).filter(F.col("score") < least)


def semantic_match(actual: Column, expected: Column, least: float = 0.6) -> Column:
    """Do two texts say the same, by their lexical score?"""
    return lexical_score(actual, expected) >= least


def promote(lines: DataFrame) -> DataFrame:
    """Trace lines of kind llm or tool as (kind, request, response); blank, unreadable and header lines are skipped."""
    kind = F.get_json_object("line", "$.kind")
    rows = lines.filter(strict_json("line").isNotNull() & F.get_json_object("line", "$._meta").isNull() & kind.isin("llm", "tool"))
    return rows.select(
        kind.alias("kind"),
        F.get_json_object("line", "$.request").alias("request"),
        F.coalesce(F.get_json_object("line", "$.response"), F.get_json_object("line", "$.result")).alias("response"),
    )
