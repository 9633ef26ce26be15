"""Mixing sources to target shares by weighted fair queueing.

Each source is a queue of its documents in a shuffled order; a document may come again in a later round, up
to the source's ``max_repeats``. Its virtual finish time is the number of tokens that its source has served when the
document is done, divided by the source's target share. Serving all sources in the order of these times keeps each source's
share at its target at every moment; a global range sort by time and a cut at the total budget make the selection.

Running sums over a source and over the whole queue are distributed (``operators.ordered``): no task holds a source, and the
driver holds no documents. A source's tokens are off its share of all tokens by at most its ``largest`` document and its share of the others' largest ones.

Defined results: documents without text, with a source that has no target, or with a null source are no candidates;
an empty text has no tokens and costs nothing; a share of zero or null takes nothing; repeated rows are separate records. A source without tokens (no documents, or only
empty texts) can't reach its share: it doesn't bound the total, and the report has it with share 0 and ``reachable`` false; the others
keep their proportions to each other. Targets that name one source in two spellings are added up, with the larger ``max_repeats``.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running
from tidemark.storage import broadcast_if_small, written

#: Folder of the public tokenizers' files and the vocabulary that sizes are counted in.
TOKENIZER_DIR, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before this vocabulary's merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Targets are a short list; one with more sources is served without pruning the queue.
MAX_SOURCES = 10_000
SEED = 17


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> Column:
    """Tokens of the whole text in a public vocabulary; null for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if isinstance(t, str) else None for t in texts], dtype="Int64")

    return count(text)


def source_name(source: Column) -> Column:
    """A source in its usual spelling: trimmed, lower case, underscores for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def sizes(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> tuple[DataFrame, DataFrame]:
    """(documents, sources): the candidates with the tokens of their source ``before`` them, and what each source has.

    Documents: doc_id, source, tokens, before. Sources: source, target_share, max_repeats, documents, total, largest.
    """
    wanted = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy(source_name(F.col("source")).alias("source"))
    wanted = wanted.agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", source_name(F.col("source")).alias("source"), token_count("text", tokenizer).alias("tokens"))
    docs = docs.join(broadcast_if_small(wanted.select("source")), "source", "left_semi")
    # written first: a range sort samples its input, and would encode every text a second time
    docs = written(docs.withColumn("place", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    summed = running(docs, "source", [F.col("place"), F.col("doc_id")], ["tokens"], "queue").withColumnRenamed("before_tokens", "before")
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("total"), F.max("tokens").alias("largest"))
    return summed, wanted.join(have, "source", "left").na.fill(0, ["documents", "total", "largest"])


def uses(summed: DataFrame, sources: DataFrame, until: float | None = None) -> DataFrame:
    """(doc_id, source, round, tokens, finish): every admissible use of a document with its virtual finish time.

    With ``until`` the uses that finish later aren't made: they can't be served (``last_time``).
    """
    rows = summed.join(broadcast_if_small(sources.select("source", "target_share", "max_repeats", "total")), "source")
    rounds = F.col("max_repeats")
    if until is not None:
        needed = F.ceil(F.lit(until) * F.col("target_share") / F.col("total")) + 1
        rounds = F.when(F.col("total") > 0, F.least(rounds.cast("long"), needed)).otherwise(rounds).cast("int")
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(1), rounds)))
    served = (F.col("round") - 1) * F.col("total") + F.col("before") + F.col("tokens")
    out = rows.select("doc_id", "source", "round", "tokens", (served / F.col("target_share")).alias("finish"))
    return out if until is None else out.filter(F.col("finish") <= F.lit(until))


def queue(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> tuple[DataFrame, DataFrame]:
    """(queue, sources): every admissible use of a document (see ``uses``), and what each source has (see ``sizes``)."""
    summed, sources = sizes(documents, targets, seed, tokenizer)
    return uses(summed, sources), sources


def last_time(sources: DataFrame, budget: int) -> float | None:
    """A virtual time by which more than ``budget`` tokens are served for sure; None if there is none.

    By time v a source has served share * v tokens less at most one document, or all it has. What finishes later lies
    beyond the cut, so it needs no place in the global sort.
    """
    rows = sources.select("target_share", (F.col("max_repeats") * F.col("total")).alias("most"), "largest").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or sum(r["most"] for r in rows) <= budget:
        return None
    enough = lambda v: sum(min(r["most"], max(0.0, r["target_share"] * v - r["largest"])) for r in rows) >= budget + 1
    high = 1.0
    while not enough(high):
        high *= 2
        if high > 1e300:
            return None
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high * (1 + 1e-9)


def reachable(sources: DataFrame) -> int:
    """The largest total at which every source that has tokens still reaches its part of the mix within its repeats.

    Its part is its share of the shares of all sources that have tokens.
    """
    have = sources.filter("total > 0")
    row = have.agg(F.min(F.col("max_repeats") * F.col("total") / F.col("target_share")).alias("b"), F.sum("target_share").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if row["n"] == sources.count():
        return int(row["b"] or 0)
    every = sources.agg(F.sum("target_share")).first()[0]
    return int(row["b"] * row["w"] / every) if row["b"] else 0


def select_mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED, tokenizer: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> tuple[DataFrame, DataFrame]:
    """(selection, report): the served uses (doc_id, source, round, tokens, finish) and the shares they reach.

    ``budget`` is the total of tokens; without one it is the largest at which all shares can be met.
    """
    summed, sources = sizes(documents, targets, seed, tokenizer)
    sources = written(sources, "sources")
    total = reachable(sources) if budget is None else budget
    candidates = uses(summed, sources, last_time(sources, total))
    order = [F.col("finish"), F.col("source"), F.col("round"), F.col("doc_id")]
    served = running(candidates, None, order, ["tokens"], "served").filter(F.col("before_tokens") + F.col("tokens") <= F.lit(total)).drop("before_tokens")
    got = served.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("used_documents"), F.max("round").alias("most_uses"))
    report = sources.join(got, "source", "left").na.fill(0, ["tokens", "used_documents", "most_uses"])
    everything = report.agg(F.sum("tokens").alias("everything"))
    report = report.join(F.broadcast(everything)).select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "used_documents",
        "most_uses",
        F.col("total").alias("source_tokens"),
        "largest",
        "tokens",
        F.try_divide(F.col("tokens").cast("double"), F.col("everything").cast("double")).alias("share"),
        F.lit(total).cast("long").alias("budget"),
        (F.col("total") > 0).alias("reachable"),
    )
    return served, report
