"""Similarity of vectors and of texts.

Cosines of two columns are computed in DOUBLE by Catalyst's array functions. Exemplar sets are query sets of a stated size: they
are collected under a bound and shipped to every worker as one matrix of unit vectors, against which whole batches are multiplied, so every
row is compared in place, without a cross join. Defined results: a zero norm or an empty vector gives 0; null vectors give null and trip nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most exemplar vectors of a set, and how many are multiplied at once.
MAX_EXEMPLARS, BLOCK = 100_000, 1000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))


def cosine(a: Column, b: Column, same_length: bool = False) -> Column:
    """Cosine over the shorter length with full norms; with ``same_length`` vectors of unequal length give 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(_dot(a, b) / norms)
    if same_length:
        value = F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(value)
    return F.when(a.isNotNull() & b.isNotNull(), value)


def exemplars(df: DataFrame, label: str, vector: str, limit: int = MAX_EXEMPLARS) -> list[tuple[str, list[float]]]:
    """(label, vector) rows of a small table, in label order; refused above ``limit``."""
    rows = df.select(F.col(label).cast("string"), F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull()).orderBy(label).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} exemplars")
    return [(r[0], list(r[1])) for r in rows]


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows, with zeros behind the shorter ones; a missing component is 0."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            out[i, : min(width, len(v))] = np.nan_to_num(np.asarray(v, dtype=float)[:width])
    return out


def _norms(vectors: list) -> np.ndarray:
    return np.array([0.0 if v is None else float(np.sqrt(np.nansum(np.square(np.asarray(v, dtype=float))))) for v in vectors])


def best_match(vector: Column | str, items: list[tuple[str, list[float]]]) -> Column:
    """STRUCT<label, score> of the most similar exemplar; the first of equals wins."""
    labels = [n for n, _ in items]
    rows = [v for _, v in items]
    width = max((len(v) for v in rows), default=0)
    own = _norms(rows)
    unit = np.divide(_matrix(rows, width), own[:, None], out=np.zeros((len(rows), width)), where=own[:, None] > 0)

    @F.pandas_udf("label string, score double")
    def run(vectors: pd.Series) -> pd.DataFrame:
        given, norms = _matrix(list(vectors), width), _norms(list(vectors))
        given = np.divide(given, norms[:, None], out=np.zeros_like(given), where=norms[:, None] > 0)
        best, at = np.full(len(given), -np.inf), np.zeros(len(given), int)
        for low in range(0, len(unit), BLOCK):
            scores = given @ unit[low : low + BLOCK].T
            top = scores.argmax(axis=1)
            value = scores[np.arange(len(given)), top]
            better = value > best
            best[better], at[better] = value[better], top[better] + low
        known = vectors.notna().to_numpy() & (len(labels) > 0)
        return pd.DataFrame({"label": [labels[i] if k else None for i, k in zip(at, known, strict=True)], "score": np.where(known, best, np.nan)})

    found = run(vector)
    score = F.nanvl(found["score"], F.lit(None).cast("double"))
    return F.struct(found["label"].alias("label"), score.alias("score"))


def grounded(vector: Column, sources: list[tuple[str, list[float]]], least: float = 0.75) -> Column:
    """Is the best similarity to a source (from 0 upwards) at least ``least``? Without sources everything passes."""
    if not sources:
        return F.lit(True)
    score = best_match(vector, sources)["score"]
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), score) >= least)


def denied(vector: Column, topics: list[tuple[str, list[float]]], threshold: float = 0.8) -> Column:
    """The denied topic that a vector matches, null if none."""
    best = best_match(vector, topics)
    return F.when(best["score"] >= threshold, best["label"])


def words(text: Column) -> Column:
    """The distinct words (letters, digits, apostrophes) of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)))


def containment(actual: Column, expected: Column) -> Column:
    """Share of the expected words that stand in the actual text; 1 if nothing is expected."""
    want = words(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, words(actual))).cast("double") / F.size(want))


def matching_characters(a: str, b: str) -> int:
    """Characters in the recursively longest common blocks of two strings."""
    total, open_pairs = 0, [(a, b)]
    while open_pairs:
        x, y = open_pairs.pop()
        if not x or not y:
            continue
        best, at_x, at_y = 0, 0, 0
        row = [0] * (len(y) + 1)
        for i, ch in enumerate(x):
            last = 0
            for j, other in enumerate(y):
                here = row[j + 1]
                row[j + 1] = last + 1 if ch == other else 0
                if row[j + 1] > best:
                    best, at_x, at_y = row[j + 1], i - row[j + 1] + 1, j - row[j + 1] + 1
                last = here
        if best:
            total += best
            open_pairs += [(x[:at_x], y[:at_y]), (x[at_x + best :], y[at_y + best :])]
    return total


def sequence_ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters; 1 for two empty strings."""
    return 2 * matching_characters(a, b) / (len(a) + len(b)) if a or b else 1.0


def lexical_score(actual: Column, expected: Column) -> Column:
    """The larger of sequence ratio and containment, of texts reduced to their words."""
    plain = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0)), " ")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sequence_ratio(x, y) for x, y in zip(a, e, strict=True)], dtype="float64")

    return F.greatest(ratio(plain(actual), plain(expected)), containment(actual, expected))
