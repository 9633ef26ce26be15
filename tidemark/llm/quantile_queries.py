"""Queries of problem 4: percentiles of latency and cost of the ledger's llm_call payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quantiles
from tidemark.sources.tables import table
from tidemark.storage import broadcast_if_small, written

GROUP = ["model", "metric", "unit"]
QS = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def model_name(model: Column) -> Column:
    """A model in its usual spelling: trimmed, lower case, without a gateway's prefix."""
    return F.regexp_replace(F.lower(F.trim(model)), "^.*/", "")


def latency(text: Column) -> Column:
    """Milliseconds from a number, a number in a string or one with a unit (ms, s); null if negative or unreadable."""
    number = F.regexp_extract(text, r"^\s*([+-]?[0-9.]+(?:[eE][+-]?\d+)?)\s*(ms|s|sec)?\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*[+-]?[0-9.]+(?:[eE][+-]?\d+)?\s*(ms|s|sec)?\s*$", 1)
    value = F.when(unit.isin("s", "sec"), number * 1000).otherwise(number)
    return F.when(value >= 0, value)


def measures(hashes: DataFrame) -> DataFrame:
    """(model, day, metric, unit, value) of the llm_call payloads, each case once.

    Metric ``latency_ms`` has the unit ms, metric ``cost`` has its currency; values that are missing or can't be read are left out.
    """
    calls = hashes.filter("entry_type = 'llm_call' AND payload IS NOT NULL")
    cost = F.get_json_object("payload", "$.cost")
    once = F.coalesce(F.col("case_id").cast("string"), F.concat(F.lit("n"), F.xxhash64("log_id", "seq", "ts", "payload").cast("string")))
    parsed = calls.select(
        once.alias("case"),
        F.struct(
            "arrived_at",
            model_name(F.get_json_object("payload", "$.model")).alias("model"),
            F.substring("ts", 1, 10).alias("day"),
            latency(F.get_json_object("payload", "$.latency_ms")).alias("latency"),
            F.regexp_extract(cost, r"^\s*(\S+)\s+[A-Za-z]{3}\s*$", 1).try_cast("double").alias("amount"),
            F.upper(F.regexp_extract(cost, r"^\s*\S+\s+([A-Za-z]{3})\s*$", 1)).alias("currency"),
        ).alias("m"),
    )
    first = parsed.groupBy("case").agg(F.min("m").alias("m")).select("m.*")
    both = F.array(
        F.struct(F.lit("latency_ms").alias("metric"), F.lit("ms").alias("unit"), F.col("latency").alias("value")),
        F.struct(F.lit("cost").alias("metric"), F.col("currency").alias("unit"), F.when(F.col("amount") >= 0, F.col("amount")).alias("value")),
    )
    return first.select("model", "day", F.explode(both).alias("v")).select("model", "day", "v.*").filter("value IS NOT NULL")


def p4_quantiles(spark: SparkSession, directory: str) -> DataFrame:
    """Percentiles of latency, and of cost per currency, for each model over all days."""
    return quantiles.percentiles(quantiles.sketch(measures(table(spark, directory, "hashes")), GROUP, "value"), GROUP, QS)


def p4_daily(spark: SparkSession, directory: str) -> DataFrame:
    """Medians and 95th percentiles for each model and day."""
    group = ["day", *GROUP]
    found = quantiles.percentiles(quantiles.sketch(measures(table(spark, directory, "hashes")), group, "value"), group, [0.5, 0.95])
    return found.select("model", "day", "metric", "unit", "q", "n", "value", "rank_error")


def p4_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Values behind each percentile; the coarsest level of the sketches holds them exactly."""
    found = quantiles.sketch(measures(table(spark, directory, "hashes")), GROUP, "value")
    return found.filter(F.col("level") == quantiles.BITS).select(*GROUP, F.get("counts", 0).alias("n"))


def _same(sketches: DataFrame, others: DataFrame) -> DataFrame:
    """(model, metric, unit, same): have both sketches of a group the same counters?"""
    digest = lambda df: df.groupBy(*GROUP).agg(F.bit_xor(F.xxhash64("level", "row", "buckets", "counts")).alias("digest"))
    a, b = digest(sketches).alias("a"), digest(others).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in GROUP]
    joined = a.join(b, on, "full")
    return joined.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in GROUP), F.col("a.digest").eqNullSafe(F.col("b.digest")).alias("same"))


def p4_merged(spark: SparkSession, directory: str) -> DataFrame:
    """The stored sketches of single days added up, against the sketch of all values."""
    rows = measures(table(spark, directory, "hashes"))
    days = written(quantiles.sketch(rows, ["day", *GROUP], "value"), "days")
    return _same(quantiles.merge(days, GROUP), quantiles.sketch(rows, GROUP, "value"))


def p4_deleted(spark: SparkSession, directory: str) -> DataFrame:
    """All values with those of even days deleted again, against the sketch of the other days' values."""
    rows = measures(table(spark, directory, "hashes"))
    even = F.coalesce(F.substring("day", 10, 1).cast("int") % 2 == 0, F.lit(False))
    deleted = quantiles.sketch(rows.withColumn("w", F.when(even, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))).withColumn("w", F.explode("w")), GROUP, "value", "w")
    return _same(deleted, quantiles.sketch(rows.filter(~even), GROUP, "value"))


def p4_ranks(spark: SparkSession, directory: str) -> DataFrame:
    """Is each percentile's exact rank within the stated error? (model, metric, unit, q, n, within)"""
    rows = written(measures(table(spark, directory, "hashes")), "measures")
    found = quantiles.percentiles(quantiles.sketch(rows, GROUP, "value"), GROUP, QS)
    per = written(found.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("q", "value", "rank_error"))).alias("p")), "percentiles")
    a, b = rows.alias("a"), broadcast_if_small(per).alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in GROUP]).select(*(f"a.{c}" for c in GROUP), F.col("a.value").alias("v"), "b.p")
    cell = 2.0**-quantiles.FRACTION
    at = lambda i: F.get("p", i)
    counts = [F.struct(F.any_value(at(i)).alias("p"), F.count_if(F.col("v") < at(i)["value"] * (1 - cell)).alias("below"), F.count_if(F.col("v") <= at(i)["value"] * (1 + cell)).alias("upto")) for i in range(len(QS))]
    out = joined.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *(c.alias(f"c{i}") for i, c in enumerate(counts)))
    out = out.select(*GROUP, "n", F.explode(F.array(*(f"c{i}" for i in range(len(QS))))).alias("c"))
    rank, slack = F.greatest(F.lit(1.0), F.ceil(F.col("c.p.q") * F.col("n"))), F.col("c.p.rank_error") * F.col("n")
    within = (F.col("c.below") + 1 - slack <= rank) & (rank <= F.col("c.upto") + slack)
    return out.select(*GROUP, F.col("c.p.q").alias("q"), "n", within.alias("within"))


QUERIES = {"p4_quantiles": p4_quantiles, "p4_daily": p4_daily, "p4_counts": p4_counts, "p4_merged": p4_merged, "p4_deleted": p4_deleted, "p4_ranks": p4_ranks}

_NUMBER = r"'^\s*([+-]?[0-9.]+(?:[eE][+-]?\d+)?)\s*(ms|s|sec)?\s*$'"
_COUNTS = f"""WITH call AS (
      SELECT coalesce(CAST(case_id AS VARCHAR), 'n' || log_id || seq || ts || payload) AS k, arrived_at,
        regexp_replace(lower(trim(json_extract_string(payload, '$.model'))), '^.*/', '') AS model,
        TRY_CAST(nullif(regexp_extract(json_extract_string(payload, '$.latency_ms'), {_NUMBER}, 1), '') AS DOUBLE) AS latency,
        json_extract_string(payload, '$.cost') AS cost
      FROM hashes WHERE entry_type = 'llm_call' AND payload IS NOT NULL),
    once AS (SELECT * FROM call QUALIFY row_number() OVER (PARTITION BY k ORDER BY arrived_at) = 1)
    SELECT model, 'latency_ms' AS metric, 'ms' AS unit, count(*) AS n FROM once WHERE latency >= 0 GROUP BY model
    UNION ALL
    SELECT model, 'cost', upper(regexp_extract(cost, '\\s([A-Za-z]{{3}})\\s*$', 1)) AS unit, count(*) FROM once
    WHERE TRY_CAST(regexp_extract(cost, '^\\s*(\\S+)\\s+[A-Za-z]{{3}}\\s*$', 1) AS DOUBLE) >= 0 GROUP BY ALL"""
_GROUPS = f"SELECT model, metric, unit, n FROM ({_COUNTS})"
#: Groups with a value on an odd day (or without a day); the others have no sketch once the even days are deleted.
_ODD = _COUNTS.replace("WHERE entry_type", "WHERE coalesce(TRY_CAST(substr(ts, 10, 1) AS INT) % 2, 1) = 1 AND entry_type")
SQL = {
    "p4_counts": _COUNTS,
    "p4_merged": f"SELECT model, metric, unit, true AS same FROM ({_GROUPS})",
    "p4_deleted": f"SELECT model, metric, unit, true AS same FROM ({_ODD})",
    "p4_ranks": f"SELECT model, metric, unit, q, n, true AS within FROM ({_GROUPS}), (SELECT unnest({QS}::DOUBLE[]) AS q)",
}
