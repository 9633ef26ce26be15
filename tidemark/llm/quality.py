"""Per-document text statistics, and the shape that a Gaussian mixture reads from them.

``statistics`` reads each text once, in Arrow batches: word count, mean word length, symbol ratio, share of lines that end in
punctuation and share of common words of the text as it stands, and features of its look-alike form that tell lines of prose
from items, cells and machine output. ``fit`` standardizes them over all documents and fits a mixture of Gaussians with
diagonal covariances by expectation-maximization; every iteration is one pass over the table of statistics that
sums each partition's responsibilities, so the model sees all documents and only its sums reach the driver.
The components start at the inspected examples of ``shapes`` and get their labels from them afterwards.

Defined results: a null text has null statistics and no shape; an empty or blank text has zero counts and
null ratios, and the shape ``junk``; repeated rows are rows; an empty table fits nothing and gives no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shapes
from tidemark.llm.lookalikes import Rewriter, default_rewriter
from tidemark.storage import written

#: The list of common words is shipped to every worker; a longer list is refused.
MAX_COMMON_WORDS = 1_000_000
#: Expectation-maximization ends when an iteration adds less than this to the mean log-likelihood; that it never does is an error.
LEAST_GAIN, ITERATIONS = 1e-3, 500
#: Smallest variance of a standardized statistic within a component.
LEAST_VARIANCE = 0.1
#: Weight of a component's inspected examples against its share of the documents.
EXAMPLE_WEIGHT = 0.02

STATISTICS = ["word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words"]
FEATURES = [
    "f_words", "f_word_length", "f_symbols", "f_punctuated", "f_common", "f_digits", "f_line_words", "f_markers", "f_cells", "f_sentences",
    "f_distinct_lines", "f_distinct_words", "f_odd_words", "f_broken", "f_long_lines",
]

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LINE_END = re.compile(r"\r\n|\n|\r")
_DIGIT = re.compile(r"\d")
_PUNCTUATED = re.compile(r"[.!?…][\"”»’')\]]*\s*$")
_SENTENCE = re.compile(r"(?<=[^\W_]|[\"”»)])[.!?…]+[\"”»)]*(?:\s|$)")
_MARKER = re.compile(r"\s*(?:[-*+•–—·▪◦‣▸►→⇒»>✓✔☐☑☒○●■□]\s|\[[ xX]?\]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|(?i:step|schritt|étape|paso|punkt|item)\s+\d+\s*[:.)])")
#: A word that a code holds and a language doesn't.
_ODD = re.compile(r"\d[^\W\d_].*\d|[^\W\d_]\d+[^\W\d_]|^[^\W_]{25,}$")
_RULE = re.compile(r"[+|][-=+|: ]+[+|]$")
_SEMICOLONS = re.compile(r"(?:[^;]{0,40};){2}")
_COMMAS = re.compile(r"(?:(?:\"[^\"]*\"|[^,\s]{1,30}(?: [^,\s]{1,20})?)?,){2,}[^,]{0,40}$")
_GAP = re.compile(r"\S {3,}\S")
_PAIR = re.compile(r"\s*[\w. -]{1,24}\s*[:=]\s{0,4}\S{0,24}\s*$")
_COLUMNS = re.compile(r"\S{1,20}\s{2,}\S{1,20}(?:\s{2,}|$)")
_BROKEN = "ÂÃâ€¿½�□■◆¤¶†‡"


def _is_cells(line: str) -> bool:
    """Is the line a row of cells, or of name and value? A sign of each form is looked for before its pattern."""
    return (
        "\t" in line
        or line.count("|") >= 2
        or line[0] in "+|" and _RULE.match(line) is not None
        or line.count(";") >= 2 and _SEMICOLONS.match(line) is not None
        or line.count(",") >= 2 and _COMMAS.match(line) is not None
        or "   " in line and _GAP.search(line) is not None
        or (":" in line or "=" in line) and _PAIR.match(line) is not None
        or "  " in line and _COLUMNS.match(line) is not None
    )


@dataclass(frozen=True)
class _Basis:
    """What the five statistics are made of."""

    lines: list[str]
    words: list[str]
    letters: int
    visible: int
    symbols: int
    punctuated: int
    common: int


def _basis(text: str, common: frozenset[str]) -> _Basis:
    lines = [x for x in _LINE_END.split(text) if x and not x.isspace()]
    low = text.lower()
    words = _WORD.findall(low)
    own = words if len(low) == len(text) else _WORD.findall(text)
    letters, visible = sum(map(len, own)), len("".join(text.split()))
    signs = letters - (sum(w.count("'") + w.count("’") for w in own) if "'" in text or "’" in text else 0)
    if not text.isascii():
        signs += sum(text.count(c) for c in set(text) if unicodedata.category(c)[0] == "M")
    return _Basis(lines, words, letters, visible, visible - signs, sum(_PUNCTUATED.search(x) is not None for x in lines), sum(map(common.__contains__, words)))


def _measures(text: str, common: frozenset[str], rewriter: Rewriter) -> tuple[float, ...]:
    """The numbers behind the statistics of a text as it stands, and behind the features of its look-alike form."""
    raw = base = _basis(text, common)
    plain = text
    if not text.isascii() and (alike := rewriter.lettered.intersection(text)):
        for c in alike:
            plain = plain.replace(c, rewriter.letters[c])
        base = _basis(plain, common)
    lines, words = base.lines, base.words
    size = lambda test: sum(len(x) for x in lines if test(x))
    return (
        len(raw.words), raw.letters, raw.symbols, raw.visible, raw.punctuated, len(raw.lines), raw.common,
        len(words), base.letters, base.symbols, base.visible, base.punctuated, len(lines), base.common,
        len(_DIGIT.findall(plain)), size(_MARKER.match), size(_is_cells), sum(map(len, lines)), len(_SENTENCE.findall(plain)), len(set(lines)), len(set(words)),
        sum(_ODD.search(w) is not None for w in words if len(w) >= 25 or not w.isalpha()), 0 if plain.isascii() else sum(map(plain.count, _BROKEN)),
        size(lambda x: len(x.split()) >= 7),
    )


def common_word_list(table: DataFrame, limit: int = MAX_COMMON_WORDS) -> list[str]:
    """The distinct common words of a table (lang, rank_no, word), in lower case."""
    rows = table.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} common words")
    return sorted(r[0] for r in rows)


def _table(rows: np.ndarray) -> pd.DataFrame:
    """The five statistics and the features from the measures of some texts; NaN where a text is null or a ratio has no denominator."""
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda i, j: np.where(rows[:, j] > 0, rows[:, i] / rows[:, j], np.nan)
        zero = np.nan_to_num
        out = {"word_count": rows[:, 0], "mean_word_length": share(1, 0), "symbol_ratio": share(2, 3), "punctuated_lines": share(4, 5), "common_words": share(6, 0)}
        features = [
            np.log1p(rows[:, 7]), np.log1p(zero(share(8, 7))), np.sqrt(zero(share(9, 10))), zero(share(11, 12)), zero(share(13, 7)), np.sqrt(zero(share(14, 8))), np.log1p(zero(share(7, 12))),
            zero(share(15, 17)), zero(share(16, 17)), np.sqrt(zero(share(18, 7))), zero(share(19, 12)), np.log(np.maximum(0.05, zero(rows[:, 20] / rows[:, 7] ** 0.75))),
            np.sqrt(zero(share(21, 7))), np.sqrt(zero(share(22, 10))), zero(share(23, 17)),
        ]
    return pd.DataFrame(out | dict(zip(FEATURES, features, strict=True)))


def statistics(documents: DataFrame, common: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the five statistics and the features of the mixture, for each row; a narrow plan, every text is read once."""
    known = frozenset(common)
    names = [*STATISTICS, *FEATURES]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def measure(texts: pd.Series) -> pd.DataFrame:
        rewriter = default_rewriter()
        none = (np.nan,) * 24
        rows = [_measures(t, known, rewriter) if isinstance(t, str) else none for t in texts]
        return _table(np.array(rows, dtype=float).reshape(len(rows), 24))

    df = documents.select(*keep, measure(F.col(text)).alias("__m"))
    value = lambda n: F.nanvl(F.col(f"__m.{n}"), F.lit(None).cast("double"))
    return df.select(*keep, value("word_count").cast("long").alias("word_count"), *(value(n).alias(n) for n in names[1:]))


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture: the scale of the features, weights, means and variances, and each component's label."""

    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    labels: tuple[str, ...]
    #: Mean log-likelihood before each iteration.
    likelihoods: tuple[float, ...] = ()

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row under each component."""
        z = (x - self.center) / self.spread
        out = np.empty((len(z), len(self.weights)))
        for k in range(len(self.weights)):
            d = z - self.means[k]
            out[:, k] = np.log(self.weights[k]) - 0.5 * (np.log(2 * np.pi * self.variances[k]).sum() + (d * d / self.variances[k]).sum(axis=1))
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities of the components for each row, and the rows' log-likelihoods."""
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return np.exp(logs - total[:, None]), total


def _step(features: DataFrame, model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Sums of responsibilities, of values and of squares over all rows; log-likelihood; rows."""
    k, d = model.means.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (1 + 2 * d) + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            r, like = model.responsibilities(x)
            z = (x - model.center) / model.spread
            total += np.concatenate([r.sum(axis=0), (r.T @ z).ravel(), (r.T @ (z * z)).ravel(), [like.sum(), len(x)]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "v": total})

    rows = features.select(*FEATURES).mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k * (1 + 2 * d) + 2)
    for i, v in rows:
        flat[i] = v
    return flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : -2].reshape(k, d), float(flat[-2]), int(flat[-1])


def fit(features: DataFrame, examples: pd.DataFrame, iterations: int | None = None) -> Mixture | None:
    """Fit the mixture to all rows of ``features``; ``examples`` has the features, ``component`` and ``shape``.

    Iterates until the likelihood has converged; with ``iterations`` just so many times.
    """
    moments = features.agg(*(f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if moments[0] is None:
        return None
    center = np.array([moments[f"m_{c}"] for c in FEATURES])
    spread = np.array([max(moments[f"s_{c}"], 1e-3) for c in FEATURES])
    z = (examples[FEATURES].to_numpy(dtype=float) - center) / spread
    names = list(dict.fromkeys(examples["component"]))
    member = np.array([[c == n for c in examples["component"]] for n in names], dtype=float)
    first_means = (member @ z) / member.sum(axis=1, keepdims=True)
    first_vars = np.maximum((member @ (z * z)) / member.sum(axis=1, keepdims=True) - first_means**2, 0.15)
    k = len(names)
    model = Mixture(center, spread, np.full(k, 1 / k), first_means, first_vars, tuple(names))
    likelihoods: list[float] = []
    while True:
        n_k, s1, s2, like, n = _step(features, model)
        likelihoods.append(like / n if n else 0.0)
        prior = EXAMPLE_WEIGHT * n / k
        total = n_k + prior
        means = (s1 + prior * first_means) / total[:, None]
        squares = (s2 + prior * (first_vars + first_means**2)) / total[:, None]
        variances = np.maximum(squares - means**2, LEAST_VARIANCE)
        model = Mixture(center, spread, total / total.sum(), means, variances, tuple(names), tuple(likelihoods))
        if len(likelihoods) == iterations or n == 0:
            break
        if iterations is None and len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < LEAST_GAIN:
            break
        if len(likelihoods) >= ITERATIONS:
            raise RuntimeError(f"the mixture hasn't converged after {ITERATIONS} iterations")
    return labelled(model, examples)


def labelled(model: Mixture, examples: pd.DataFrame) -> Mixture:
    """Each component takes the shape of the inspected examples that it is responsible for."""
    r, _ = model.responsibilities(examples[FEATURES].to_numpy(dtype=float))
    own = dict(zip(examples["component"], examples["shape"], strict=True))
    labels = []
    for k, name in enumerate(model.labels):
        votes = {s: float(r[(examples["shape"] == s).to_numpy(), k].sum()) for s in shapes.SHAPES}
        best = max(votes, key=votes.get)
        labels.append(best if votes[best] > 0.5 else own[name])
    return Mixture(model.center, model.spread, model.weights, model.means, model.variances, tuple(labels), model.likelihoods)


def shape_of(features: DataFrame, model: Mixture, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``shape`` and its posterior ``certainty`` for each row of the statistics."""
    kinds = list(shapes.SHAPES)
    belongs = np.array([[label == s for s in kinds] for label in model.labels], dtype=float)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[FEATURES].to_numpy(dtype=float)
            p = model.responsibilities(x)[0] @ belongs if len(x) else np.empty((0, len(kinds)))
            best = p.argmax(axis=1)
            out = batch[list(keep)].copy()
            out["shape"] = ["junk" if w == 0 else kinds[i] for i, w in zip(best, x[:, 0], strict=True)]
            out["certainty"] = p[np.arange(len(best)), best]
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in features.select(*keep).schema.fields)
    return features.select(*keep, *FEATURES).mapInPandas(classify, f"{fields}, shape string, certainty double")


def document_shapes(documents: DataFrame, common: list[str]) -> DataFrame:
    """(doc_id, shape, certainty) of every document with a text, by a mixture fitted to all of them."""
    spark = documents.sparkSession
    rows = written(statistics(documents.filter(F.col("text").isNotNull()), common).drop(*STATISTICS), "statistics")
    texts = spark.createDataFrame(shapes.examples(), "component string, shape string, text string")
    examples = statistics(texts, common, keep=("component", "shape")).toPandas()
    model = fit(rows, examples)
    if model is None:
        return rows.select("doc_id", F.lit("").alias("shape"), F.lit(0.0).alias("certainty"))
    return shape_of(rows, model)
