"""Queries of content rules and of similarity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import gates, similarity
from tidemark.sources.tables import table

DENIED = ["retry queue", "fallback model", "drop table"]
WORDS = ["cap", "ledger export"]
ALLOWED = ["vintari.test", "kelpworks.example"]
MAX_CHARS, MAX_TOKENS = 1500, 420


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", "text", "lang")


def gate_keywords(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that a substring deny list blocks, with the matched term."""
    rule = gates.keyword_deny(DENIED)
    rows = _documents(spark, directory).withColumn("v", rule.check(F.col("text"))).filter("v IS NOT NULL")
    return rows.select("doc_id", "v.action", "v.reason")


def gate_words(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with their text after word-wise redaction; only changed ones."""
    rule = gates.keyword_deny(WORDS, action="redact", match="word")
    rows = _documents(spark, directory).withColumn("v", rule.check(F.col("text"))).filter("v IS NOT NULL")
    return rows.select("doc_id", F.md5("v.replacement").alias("text_md5"))


def gate_lengths(spark: SparkSession, directory: str) -> DataFrame:
    """Documents over the bounds, characters before tokens."""
    rule = gates.length_bounds(MAX_CHARS, MAX_TOKENS)
    rows = _documents(spark, directory).withColumn("v", rule.check(F.col("text"))).filter("v IS NOT NULL")
    return rows.select("doc_id", "v.reason")


def gate_languages(spark: SparkSession, directory: str) -> DataFrame:
    """Documents in a language that isn't allowed."""
    rule = gates.language_rule(F.col("lang"), ["en", "de"], action="flag")
    rows = _documents(spark, directory).withColumn("v", rule.check(F.col("text"))).filter("v IS NOT NULL")
    return rows.select("doc_id", "v.reason")


def gate_hosts(spark: SparkSession, directory: str) -> DataFrame:
    """The first host of each recorded request that isn't on the allow list; the recordings have no URLs, so some are added."""
    rows = table(spark, directory, "llm").select("cassette_id", "arrived_at", F.explode("entries").alias("e"))
    links = F.when(F.col("e.seq") % 2 == 0, " https://a.vintari.test/x http://Other.Example/y").otherwise(" http://kelpworks.example")
    rows = rows.withColumn("v", gates.url_rule(ALLOWED, allow=True).check(F.concat("e.request", links))).filter("v IS NOT NULL")
    return rows.select("cassette_id", "arrived_at", "e.seq", "v.reason")


def gate_evaluate(spark: SparkSession, directory: str) -> DataFrame:
    """A chain of rules: flag numbers, redact a word, wrap nothing that is blocked for its length."""
    rules = [
        gates.regex_rule(r"\b\d{2,}\b", name="numbers"),
        gates.keyword_deny(["retry queue"], action="redact", name="queue"),
        gates.length_bounds(max_chars=MAX_CHARS, name="length"),
        gates.keyword_deny(["[redacted]"], action="flag", name="after"),
    ]
    rows = gates.evaluate(_documents(spark, directory).filter("text IS NOT NULL"), "text", rules)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "blocked", F.array_join(F.transform("decisions", lambda d: F.concat(d.rule, F.lit(":"), d.action)), ",").alias("decisions"))


def gate_redteam(spark: SparkSession, directory: str) -> DataFrame:
    """Red-team tally per source: documents that mention a ledger are the attacks, a deny list is the defence."""
    rows = _documents(spark, directory).filter("text IS NOT NULL")
    tripped = gates.keyword_deny(["retry queue", "fallback model"]).check(F.col("text")).isNotNull()
    return gates.tally(rows, F.lower("text").contains("queue"), tripped, F.lower("lang"))


def _topics(spark: SparkSession, directory: str) -> list[tuple[str, list[float]]]:
    """One exemplar per label: its vector with the smallest id (ten labels, whatever the scale)."""
    rows = table(spark, directory, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return similarity.exemplars(rows, "label", "embedding")


def vector_topics(spark: SparkSession, directory: str) -> DataFrame:
    """The best topic of every vector and its score, and the denied topic if it reaches the threshold."""
    topics = _topics(spark, directory)
    rows = table(spark, directory, "embeddings").withColumn("best", similarity.best_match(F.col("embedding"), topics))
    return rows.select("vec_id", F.col("best.label").alias("topic"), F.round("best.score", 6).alias("score"), (F.col("best.score") >= 0.8).alias("denied"))


def vector_grounded(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors that no exemplar grounds."""
    topics = _topics(spark, directory)
    rows = table(spark, directory, "embeddings").filter(~similarity.grounded(F.col("embedding"), topics, 0.5))
    return rows.select("vec_id", "label")


def lexical_containment(spark: SparkSession, directory: str) -> DataFrame:
    """Share of an item's passage words in its instruction, for every item."""
    rows = table(spark, directory, "eval_items")
    return rows.select("item_id", F.round(similarity.containment(F.col("passage"), F.col("instruction")), 6).alias("score"))


def lexical_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Lexical score of every item's passage against its instruction."""
    rows = table(spark, directory, "eval_items")
    return rows.select("item_id", F.round(similarity.lexical_score(F.col("passage"), F.col("instruction")), 6).alias("score"))


QUERIES = {
    "gate_keywords": gate_keywords,
    "gate_words": gate_words,
    "gate_lengths": gate_lengths,
    "gate_languages": gate_languages,
    "gate_hosts": gate_hosts,
    "gate_evaluate": gate_evaluate,
    "gate_redteam": gate_redteam,
    "vector_topics": vector_topics,
    "vector_grounded": vector_grounded,
    "lexical_containment": lexical_containment,
    "lexical_scores": lexical_scores,
}

_DENY = "(?i)" + "|".join(DENIED)
_PIECES = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

_BLANKS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
#: Words with the character on either side, as there is no looking around here; a second pass finds words that share such a character.
_EDGED = r"(^|[^\p{L}\p{N}_])(" + "|".join(w.replace(" ", _BLANKS) for w in WORDS) + r")($|[^\p{L}\p{N}_])"


def tokens_sql(t: str) -> str:
    """The token estimate of a text column in SQL."""
    pieces = f"len(regexp_extract_all({t}, '{_PIECES}'))"
    return f"CASE WHEN len({t}) = 0 THEN 0 ELSE CAST(greatest(1, ceil((len({t}) / 3.5::DOUBLE + {pieces} * 1.2::DOUBLE) / 2)) AS BIGINT) END"


_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
_SCORED = f"""WITH topic AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS b FROM embeddings GROUP BY label),
  vec AS (SELECT vec_id, label AS own, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
  scored AS (SELECT vec_id, own, CAST(label AS VARCHAR) AS topic, {_COS} AS score FROM vec, topic)"""
SQL = {
    "gate_keywords": f"""SELECT doc_id, 'block' AS action, 'denied keyword: "' || regexp_extract(text, '{_DENY}') || '"' AS reason
      FROM documents WHERE regexp_matches(text, '{_DENY}')""",
    "gate_words": f"""WITH one AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{_EDGED}', '\\1[redacted]\\3', 'gi'), '{_EDGED}', '\\1[redacted]\\3', 'gi') AS t FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, md5(t) AS text_md5 FROM one WHERE t <> text""",
    "gate_lengths": f"""SELECT doc_id, CASE WHEN len(text) > {MAX_CHARS} THEN len(text) || ' chars exceeds max {MAX_CHARS}'
        ELSE n || ' tokens exceeds max {MAX_TOKENS}' END AS reason
      FROM (SELECT doc_id, text, {tokens_sql('text')} AS n FROM documents WHERE text IS NOT NULL) WHERE len(text) > {MAX_CHARS} OR n > {MAX_TOKENS}""",
    "gate_languages": "SELECT doc_id, 'language ' || lang AS reason FROM documents WHERE trim(text) <> '' AND lower(lang) NOT IN ('en', 'de')",
    "gate_hosts": r"""SELECT cassette_id, arrived_at, e.seq AS seq, 'URL host not allowlisted: ' || bad[1] AS reason FROM (
      SELECT cassette_id, arrived_at, e, list_filter(list_transform(regexp_extract_all(e.request || CASE WHEN e.seq % 2 = 0 THEN ' https://a.vintari.test/x http://Other.Example/y' ELSE ' http://kelpworks.example' END, '(?i)https?://([^\s<>)\]}"'':/?#]+)', 1), lambda h: lower(h)),
        lambda h: NOT (h IN ('vintari.test', 'kelpworks.example') OR ends_with(h, '.vintari.test') OR ends_with(h, '.kelpworks.example'))) AS bad
      FROM (SELECT cassette_id, arrived_at, unnest(entries) AS e FROM llm)) WHERE len(bad) > 0""",
    "gate_evaluate": f"""WITH one AS (SELECT doc_id, text, regexp_matches(text, '\\b\\d{{2,}}\\b') AS numbers, regexp_matches(text, '(?i)retry queue') AS queue FROM documents WHERE text IS NOT NULL),
      two AS (SELECT *, regexp_replace(text, '(?i)retry queue', '[redacted]', 'g') AS t FROM one),
      three AS (SELECT *, len(t) > {MAX_CHARS} AS blocked, contains(t, '[redacted]') AS seen FROM two)
      SELECT doc_id, md5(t) AS text_md5, blocked, array_to_string(list_filter([CASE WHEN numbers THEN 'numbers:flag' END, CASE WHEN queue THEN 'queue:redact' END,
        CASE WHEN blocked THEN 'length:block' END, CASE WHEN NOT blocked AND seen THEN 'after:flag' END], lambda x: x IS NOT NULL), ',') AS decisions FROM three""",
    "gate_redteam": """SELECT category, count(*) AS total, count(*) FILTER (attack) AS attacks, count(*) FILTER (attack AND tripped) AS caught,
      count(*) FILTER (NOT attack AND tripped) AS false_positives, count(*) FILTER (NOT attack) AS benign,
      coalesce(count(*) FILTER (attack AND tripped) / nullif(count(*) FILTER (attack), 0)::DOUBLE, 0) AS trip_rate,
      coalesce(count(*) FILTER (NOT attack AND tripped) / nullif(count(*) FILTER (NOT attack), 0)::DOUBLE, 0) AS false_positive_rate
      FROM (SELECT lower(lang) AS category, contains(lower(text), 'queue') AS attack, regexp_matches(text, '(?i)retry queue|fallback model') AS tripped FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
    "vector_topics": f"""{_SCORED} SELECT vec_id, topic, round(score, 6) AS score, score >= 0.8 AS denied FROM scored
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) = 1""",
    "vector_grounded": f"{_SCORED} SELECT vec_id, any_value(own) AS label FROM scored GROUP BY vec_id HAVING greatest(0, max(score)) < 0.5",
    "lexical_containment": """SELECT item_id, round(CASE WHEN len(e) = 0 THEN 1 ELSE len(list_intersect(e, a)) / len(e)::DOUBLE END, 6) AS score FROM (
      SELECT item_id, list_distinct(regexp_extract_all(lower(instruction), '[a-z0-9'']+')) AS e, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9'']+')) AS a FROM eval_items)""",
}
