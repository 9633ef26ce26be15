"""Queries of problem 3: inputs and requests that look the same but differ in their characters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lookalikes import canonical, default_rewriter, frequencies
from tidemark.sources.tables import table
from tidemark.storage import broadcast_if_small, written


def message_texts(request: dict, rewrite: Callable[[str], str]) -> None:
    """Apply ``rewrite`` to every text of the message contents, in place."""

    def part(value: object) -> object:
        if isinstance(value, str):
            return rewrite(value)
        if isinstance(value, list):
            return [part(x) for x in value]
        if isinstance(value, dict):
            return {k: rewrite(v) if k == "text" and isinstance(v, str) else part(v) if k in ("content", "parts") else v for k, v in value.items()}
        return value

    messages = request.get("messages")
    for message in messages if isinstance(messages, list) else []:
        if isinstance(message, dict) and "content" in message:
            message["content"] = part(message["content"])


def _digest(value: object) -> str:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def request_parts(request: Column | str, version: Column | str) -> Column:
    """STRUCT(frame, texts): a digest of a request with its message texts left out, and these texts in order.

    Two requests are the same where both agree; they look the same where the frames agree and the texts look the same. Version 1
    leaves ``stream`` out. A null or unreadable request gives nulls.
    """

    @F.pandas_udf("frame string, texts array<string>")
    def parts(requests: pd.Series, versions: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for text, v in zip(requests, versions, strict=True):
            found: list[str] = []
            try:
                value = json.loads(text)
                if v == 1 and isinstance(value, dict):
                    value.pop("stream", None)
                if isinstance(value, dict):
                    message_texts(value, lambda t: found.append(t) or "")
                rows.append((_digest(value), found))
            except (TypeError, ValueError, RecursionError):
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["frame", "texts"])

    return parts(request, version)


def forms(rows: DataFrame) -> DataFrame:
    """(tbl, version, key, same, form) of (tbl, version, key, frame, texts): digests of the texts as they stand and in their one form.

    The frequencies that choose the representatives are counted over all texts of ``rows``. Written, as several passes read it.
    """
    rows = written(rows.filter("key IS NOT NULL AND texts IS NOT NULL"), "texts")
    counts = frequencies(rows.select(F.explode("texts").alias("text")), "text")

    @F.pandas_udf("same binary, form binary")
    def digests(frames: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rewrite = default_rewriter(counts).rewrite
        both = []
        for frame, parts in zip(frames, texts, strict=True):
            one = lambda form, frame=frame, parts=parts: hashlib.md5(json.dumps([frame, *map(form, parts)]).encode()).digest()
            both.append((one(str), one(rewrite)))
        return pd.DataFrame(both, columns=["same", "form"])

    return written(rows.withColumn("d", digests("frame", "texts")).select("tbl", "version", "key", "d.same", "d.form"), "forms")


def classes(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, form, spellings, keys): the texts that look the same, as one row each, whatever the number of their copies.

    Counts are exact; keys are distinct. Copies are added up before anything is shuffled by the form alone.
    """
    spelled = rows.groupBy(*group, "form", "same").agg(F.countDistinct("key").alias("keys"))
    return spelled.groupBy(*group, "form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("keys").alias("keys"))


def alike_pairs(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, key_a, key_b): keys of one ``group`` and ``form`` whose ``same`` differs.

    Pairs are made between the spellings of the classes that have several; exact copies (equal ``same``) are joined as one, so a group of
    copies costs nothing unless some other spelling of its text exists. Only then its keys are listed, as the result needs them.
    """
    rows = rows.filter("form IS NOT NULL AND same IS NOT NULL AND key IS NOT NULL")
    several = classes(rows, group).filter("spellings > 1").select(*group, "form")
    members = written(rows.join(broadcast_if_small(written(several, "classes")), [*group, "form"], "left_semi").select(*group, "form", "same", "key").distinct(), "members")
    spelled = members.select(*group, "form", "same").distinct()
    left, right = spelled.withColumnRenamed("same", "same_a"), spelled.withColumnRenamed("same", "same_b")
    pairs = left.join(right, [*group, "form"]).filter("same_a < same_b")
    a = members.withColumnRenamed("same", "same_a").withColumnRenamed("key", "one")
    b = members.withColumnRenamed("same", "same_b").withColumnRenamed("key", "other")
    pairs = pairs.join(a, [*group, "form", "same_a"]).join(b, [*group, "form", "same_b"]).filter("one <> other")
    return pairs.select(*group, F.least("one", "other").alias("key_a"), F.greatest("one", "other").alias("key_b")).distinct()


def _inputs(spark: SparkSession, directory: str) -> DataFrame:
    """Each ``case_id`` once, with the input that arrived first."""
    rows = table(spark, directory, "detect").filter("case_id IS NOT NULL").select("case_id", F.struct("arrived_at", "input").alias("d"))
    return rows.groupBy("case_id").agg(F.min("d").alias("d")).select("case_id", "d.input")


def _requests(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "llm").select("format_version", F.explode("entries").alias("e"))
    return rows.select("format_version", "e.request_hash", "e.request").filter("request_hash IS NOT NULL AND request IS NOT NULL")


def _texts(spark: SparkSession, directory: str) -> DataFrame:
    """(tbl, version, key, frame, texts) of the inputs and of the requests; every text is parsed once."""
    inputs = _inputs(spark, directory).filter("input IS NOT NULL")
    inputs = inputs.select(F.lit("detect").alias("tbl"), F.lit(0).alias("version"), F.col("case_id").alias("key"), F.lit("").alias("frame"), F.array("input").alias("texts"))
    requests = _requests(spark, directory).withColumn("p", request_parts("request", "format_version"))
    version = F.coalesce(F.col("format_version").cast("int"), F.lit(-1)).alias("version")
    requests = requests.select(F.lit("llm").alias("tbl"), version, F.col("request_hash").alias("key"), "p.frame", "p.texts")
    return inputs.unionByName(requests)


def corpus_counts(spark: SparkSession, directory: str) -> tuple[tuple[str, int], ...]:
    """The frequencies that choose the representatives, over all inputs and all message texts."""
    return frequencies(_texts(spark, directory).select(F.explode("texts").alias("text")), "text")


def p3_inputs(spark: SparkSession, directory: str) -> DataFrame:
    """Each input in its one consistent form."""
    counts = corpus_counts(spark, directory)
    return _inputs(spark, directory).select("case_id", canonical("input", counts).alias("input"))


def p3_requests(spark: SparkSession, directory: str) -> DataFrame:
    """Each recorded request with a digest that is equal for equal-looking requests."""
    rows = forms(_texts(spark, directory)).filter("tbl = 'llm'")
    return rows.select(F.nullif("version", F.lit(-1)).alias("format_version"), F.col("key").alias("request_hash"), F.lower(F.hex("form")).alias("form")).distinct()


def p3_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Each class of equal-looking inputs or requests: how many spellings and how many keys it has."""
    rows = classes(forms(_texts(spark, directory)), ["tbl", "version"])
    return rows.select("tbl", F.nullif("version", F.lit(-1)).alias("format_version"), F.lower(F.hex("form")).alias("class_id"), "spellings", "keys")


def p3_members(spark: SparkSession, directory: str) -> DataFrame:
    """Each input and each request with the class that it belongs to and the spelling that it has."""
    rows = forms(_texts(spark, directory)).distinct()
    return rows.select("tbl", "key", F.nullif("version", F.lit(-1)).alias("format_version"), F.lower(F.hex("form")).alias("class_id"), F.lower(F.hex("same")).alias("spelling"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of inputs, and of requests, that look the same but are not the same characters."""
    return alike_pairs(forms(_texts(spark, directory)), ["tbl", "version"]).select("tbl", "key_a", "key_b").distinct()


QUERIES = {"p3_found": p3_found, "p3_inputs": p3_inputs, "p3_requests": p3_requests, "p3_classes": p3_classes, "p3_members": p3_members}
SQL: dict[str, str] = {}
