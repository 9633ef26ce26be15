"""Queries over the spend facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import spend as op
from tidemark.sources.tables import table

CAP = "0.50"
KEEP = 5
TOKENS = 100_000


def _spend(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "spend")


def _once(spark: SparkSession, directory: str) -> DataFrame:
    return op.once(_spend(spark, directory))


def spend_models(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, calls and unpriced calls per model, with the models that were never priced."""
    rows = _spend(spark, directory)
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.coalesce("calls", F.lit(0))).alias("calls"),
        F.count_if(F.col("unpriced")).alias("unpriced"),
        F.every(F.coalesce("unpriced", F.lit(False))).alias("never_priced"),
    )


def spend_clamped(spark: SparkSession, directory: str) -> DataFrame:
    """How many calls of each feature are allowed, clamped and blocked under a cap of tokens, and the output that they get."""
    calls = _once(spark, directory).select("spend_id", op.tag("feature").alias("feature"), "ts", F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"))
    rows = op.clamped(calls, TOKENS, "feature")
    return rows.groupBy("feature").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("allowed", "clamped", "blocked")), F.sum("output").alias("output"))


QUERIES = {
    "spend_clamped": spend_clamped,
    "spend_report_feature": lambda s, d: op.report(_spend(s, d), ["feature"]),
    "spend_report_feature_env": lambda s, d: op.report(_spend(s, d), ["feature", "env"]),
    "spend_report_all": lambda s, d: op.report(_spend(s, d), []),
    "spend_report_once": lambda s, d: op.report(_once(s, d), ["team"]),
    "spend_under_cap": lambda s, d: op.under(_spend(s, d), "20", {"feature": "code_review", "env": "prod"}),
    "spend_counters": lambda s, d: op.counters(_spend(s, d), "env"),
    "spend_models": spend_models,
    "spend_running": lambda s, d: op.running_spend(_once(s, d), op.tag("user_id"), "user_id"),
    "spend_first_breach": lambda s, d: op.first_breach(op.running_spend(_once(s, d), op.tag("user_id"), "user_id"), "user_id", CAP),
    "spend_enforced": lambda s, d: op.enforced(_once(s, d), op.tag("user_id"), CAP, "user_id"),
    "spend_retention": lambda s, d: op.newest(_once(s, d), op.tag("feature"), KEEP, "feature"),
}

_MEASURES = """CAST(sum(coalesce(usd, 0)) AS DECIMAL(38,9)) AS usd,
  CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens,
  CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
  CAST(sum(coalesce(reasoning_tokens, 0)) AS BIGINT) AS reasoning_tokens, CAST(sum(coalesce(calls, 0)) AS BIGINT) AS calls,
  CAST(sum(CASE WHEN unpriced THEN calls ELSE 0 END) AS BIGINT) AS unpriced_calls"""
_ONCE = "once AS (SELECT * FROM spend QUALIFY spend_id IS NULL OR row_number() OVER (PARTITION BY spend_id ORDER BY logged_at) = 1)"
_RUNNING = f"""{_ONCE}, run AS (SELECT spend_id, tags['user_id'] AS user_id, ts,
  CAST(sum(coalesce(usd, 0)) OVER w AS DECIMAL(38,9)) AS spent_usd,
  CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) OVER w AS BIGINT) AS spent_tokens,
  CAST(sum(coalesce(calls, 0)) OVER w AS BIGINT) AS spent_calls
  FROM once WINDOW w AS (PARTITION BY tags['user_id'] ORDER BY ts, spend_id ROWS UNBOUNDED PRECEDING))"""
SQL = {
    "spend_report_feature": f"SELECT tags['feature'] AS feature, {_MEASURES} FROM spend GROUP BY 1",
    "spend_report_feature_env": f"SELECT tags['feature'] AS feature, tags['env'] AS env, {_MEASURES} FROM spend GROUP BY 1, 2",
    "spend_report_all": f"SELECT {_MEASURES} FROM spend HAVING count(*) > 0",
    "spend_report_once": f"WITH {_ONCE} SELECT tags['team'] AS team, {_MEASURES} FROM once GROUP BY 1",
    "spend_under_cap": """SELECT usd, CAST('20' AS DECIMAL(38,9)) AS cap, usd <= 20 AS ok FROM (
      SELECT CAST(coalesce(sum(usd), 0) AS DECIMAL(38,9)) AS usd FROM spend WHERE tags['feature'] = 'code_review' AND tags['env'] = 'prod')""",
    "spend_counters": """SELECT model, tags['env'] AS env, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens,
      CAST(coalesce(sum(usd), 0) AS DECIMAL(38,9)) AS cost, CAST(sum(coalesce(reasoning_tokens, 0)) AS BIGINT) AS reasoning FROM spend GROUP BY 1, 2""",
    "spend_models": """SELECT model, count(*) AS rows, CAST(sum(coalesce(calls, 0)) AS BIGINT) AS calls, count(*) FILTER (unpriced) AS unpriced,
      bool_and(coalesce(unpriced, false)) AS never_priced FROM spend GROUP BY 1""",
    "spend_running": f"WITH {_RUNNING} SELECT * FROM run",
    "spend_first_breach": f"""WITH {_RUNNING} SELECT user_id, arg_min(spend_id, (ts, spend_id)) AS spend_id, min(spent_usd) AS spent_usd
      FROM run WHERE spent_usd > {CAP} GROUP BY user_id""",
    "spend_enforced": f"""WITH {_ONCE}, per AS (SELECT tags['user_id'] AS user_id, list({{'id': spend_id, 'usd': CAST(coalesce(usd, 0) AS DECIMAL(38,9))}} ORDER BY ts, spend_id) AS calls FROM once GROUP BY 1),
      fold AS (SELECT user_id, list_reduce(list_transform(calls, lambda c: {{'spent': c.usd, 'ids': [c.id]}}), lambda a, c: CASE WHEN a.spent + c.spent <= {CAP}
        THEN {{'spent': CAST(a.spent + c.spent AS DECIMAL(38,9)), 'ids': list_concat(a.ids, c.ids)}} ELSE a END, {{'spent': CAST(0 AS DECIMAL(38,9)), 'ids': CAST([] AS BIGINT[])}}).ids AS ids FROM per)
      SELECT o.spend_id, f.user_id, list_contains(f.ids, o.spend_id) AS allowed FROM once o JOIN fold f ON o.tags['user_id'] IS NOT DISTINCT FROM f.user_id""",
    "spend_clamped": f"""WITH {_ONCE}, per AS (SELECT tags['feature'] AS feature, list({{'i': coalesce(input_tokens, 0), 'o': coalesce(output_tokens, 0)}} ORDER BY ts, spend_id) AS calls FROM once GROUP BY 1),
      fold AS (SELECT feature, list_reduce(list_transform(calls, lambda c: {{'room': CAST(c.i AS BIGINT), 'a': CAST(c.o AS BIGINT), 'c': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'out': CAST(0 AS BIGINT)}}),
        lambda s, x: CASE WHEN s.room - x.room <= 0 THEN {{'room': s.room, 'a': s.a, 'c': s.c, 'b': s.b + 1, 'out': s.out}}
          WHEN x.a > s.room - x.room THEN {{'room': CAST(0 AS BIGINT), 'a': s.a, 'c': s.c + 1, 'b': s.b, 'out': CAST(s.out + s.room - x.room AS BIGINT)}}
          ELSE {{'room': CAST(s.room - x.room - x.a AS BIGINT), 'a': s.a + 1, 'c': s.c, 'b': s.b, 'out': CAST(s.out + x.a AS BIGINT)}} END,
        {{'room': CAST({TOKENS} AS BIGINT), 'a': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'out': CAST(0 AS BIGINT)}}) AS f FROM per)
      SELECT feature, f.a AS allowed, f.c AS clamped, f.b AS blocked, f.out AS output FROM fold""",
    "spend_retention": f"""WITH {_ONCE} SELECT spend_id, tags['feature'] AS feature FROM once
      QUALIFY row_number() OVER (PARTITION BY tags['feature'] ORDER BY ts DESC, spend_id DESC) <= {KEEP}""",
}
