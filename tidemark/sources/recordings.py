"""Audit-chain lines and recorded cassettes as records of JSON text, each delivered record once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json import strict_json
from tidemark.operators import ingest


def chain_records(chain: DataFrame, parsed: bool = False) -> DataFrame:
    """(tbl, record_id, doc): the readable lines of ``chain_signed``, as text or (``parsed``) as VARIANT.

    A header is ``<chain_id>/meta``, an entry ``<chain_id>/<seq>``; a line without ``seq`` is known by
    its line number (``<chain_id>/line<n>``). Blank, null and cut lines are left out; of a record that
    was delivered twice the first line counts.
    """
    doc = strict_json("line")
    lines = chain.select("chain_id", "line_no", F.col("line").alias("doc"), doc.alias("v")).filter(F.col("v").isNotNull())
    seq = F.try_variant_get("v", "$.seq", "string")
    name = F.when(F.try_variant_get("v", "$._meta", "variant").isNotNull(), F.lit("meta")).otherwise(
        F.coalesce(seq, F.concat(F.lit("line"), F.col("line_no")))
    )
    lines = lines.select(F.concat(F.coalesce("chain_id", F.lit("")), F.lit("/"), name).alias("record_id"), "line_no", "v" if parsed else "doc")
    order = F.coalesce("line_no", F.lit(2**31 - 1))
    first = lines.groupBy("record_id").agg(F.min_by("v", order).alias("doc") if parsed else F.min_by("doc", F.struct(order, "doc")).alias("doc"))
    return first.select(F.lit("chain_signed").alias("tbl"), "record_id", "doc")


def recorded_calls(llm: DataFrame) -> DataFrame:
    """One row per recorded call of a model or tool: (cassette_id, seq, arrived_at, kind, provider, model, messages, name, args, kwargs, text, usage).

    What a kind doesn't have is null; a tool's arguments come as {args, kwargs} in JSON. Unreadable requests are left out.
    """
    rows = llm.select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    rows = rows.select("cassette_id", "arrived_at", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), strict_json("e.request").alias("q"), F.col("e.response").alias("response")).filter("q IS NOT NULL")
    get = lambda p, t="string": F.try_variant_get("q", p, t)
    shaped = get("$.arguments.args", "variant").isNotNull() | get("$.arguments.kwargs", "variant").isNotNull()
    tool = F.col("kind") == "tool"
    return rows.select(
        "cassette_id",
        "seq",
        "arrived_at",
        "kind",
        get("$.provider").alias("provider"),
        get("$.model").alias("model"),
        F.size(get("$.messages", "array<variant>")).alias("messages"),
        F.when(tool, get("$.name")).alias("name"),
        F.when(tool, F.when(shaped, F.to_json(get("$.arguments.args", "variant"))).otherwise("[]")).alias("args"),
        F.when(tool, F.when(shaped, F.to_json(get("$.arguments.kwargs", "variant"))).otherwise(F.to_json(get("$.arguments", "variant")))).alias("kwargs"),
        ingest.text(F.col("response")).alias("text"),
        ingest.usage(F.col("response"), get("$.provider")).alias("usage"),
    )


def cassette_records(llm: DataFrame) -> DataFrame:
    """(tbl, record_id, request, response): the entries of the ``llm`` cassettes.

    ``record_id`` is ``<cassette_id>/<seq>``. Null and empty ``entries`` give no row; of an entry that
    was delivered twice the one that arrived first counts.
    """
    rows = llm.select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    seq = F.coalesce(F.col("e.seq").cast("string"), F.lit("null"))
    rows = rows.select(
        F.concat(F.coalesce("cassette_id", F.lit("")), F.lit("/"), seq).alias("record_id"),
        F.struct(
            F.coalesce("arrived_at", F.lit("9999-01-01").cast("timestamp_ntz").cast("timestamp")).alias("at"),
            F.col("e.request").alias("request"),
            F.col("e.response").alias("response"),
        ).alias("entry"),
    )
    first = rows.groupBy("record_id").agg(F.min("entry").alias("entry"))
    return first.select(F.lit("llm").alias("tbl"), "record_id", "entry.request", "entry.response")
