"""Text statistics against plain Python, and shapes of texts that aren't among the examples."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import shapes

COMMON = ["the", "of", "and", "a", "to", "is", "der", "und", "que", "la"]
PROSE = "Nobody at the office had read the report. It was late, and a part of the answer was lost.\nThe desk is to check the numbers again, and to write down what it found."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    sentences = [
        "The crew of the boat is to return before noon, and the pilot waits at the quay.",
        "A part of the harvest was lost to the rain, which is the reason for the price.",
        "Nobody knows whether the mill is to open again, and the owner of it is abroad.",
        "What the clerk wrote to the bank was never answered by anyone in the office.",
    ]
    things = ["the red kettle", "two spare ropes", "a letter to the bank", "the key of the shed", "fresh paint"]
    rows = []
    for i in range(240):
        kind = i % 6
        pick = lambda xs, n: [xs[j] for j in rng.integers(0, len(xs), n)]
        if kind in (0, 1, 2):
            rows.append((i, "\n\n".join(" ".join(pick(sentences, 4)) for _ in range(1 + i % 3)), "prose"))
        elif kind == 3:
            rows.append((i, "\n".join(f"- {x}" for x in pick(things, 9)), "list"))
        elif kind == 4:
            rows.append((i, "\n".join(";".join(str(rng.integers(0, 9999)) if j % 2 else "ok" for j in range(5)) for _ in range(9)), "table"))
        else:
            rows.append((i, "\n".join("".join(pick("abcdefghijkXYZ0123456789+/", 76)) for _ in range(8)), "junk"))
    return spark.createDataFrame(rows, "doc_id long, text string, shape string")


def test_shapes_of_unseen_texts(corpus):
    got = {r.doc_id: r["shape"] for r in Q.document_shapes(corpus, COMMON).collect()}
    wrong = [(r.doc_id, r["shape"], got[r.doc_id]) for r in corpus.collect() if got[r.doc_id] != r["shape"]]
    assert len(wrong) <= 2, wrong


def test_five_statistics(spark):
    row = Q.statistics(spark.createDataFrame([(1, PROSE)], "doc_id long, text string"), COMMON).first()
    words = re.findall(r"\w+", PROSE)
    visible = [c for c in PROSE if not c.isspace()]
    assert row.word_count == len(words)
    assert row.mean_word_length == pytest.approx(np.mean([len(w) for w in words]))
    assert row.symbol_ratio == pytest.approx(sum(not c.isalnum() for c in visible) / len(visible))
    assert row.punctuated_lines == 1.0
    assert row.common_words == pytest.approx(sum(w.lower() in COMMON for w in words) / len(words))


def test_nulls_empty_blank_long_and_lookalike_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 100_000), (5, "Ｔｈｅ ｏｆｆｉｃｅ"), (5, "Ｔｈｅ ｏｆｆｉｃｅ")]
    got = {r.doc_id: r for r in Q.statistics(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit(1)), COMMON).collect()}
    assert got[1].word_count is None and got[1].mean_word_length is None
    assert got[2].word_count == got[3].word_count == 0 and got[2].symbol_ratio is None
    # the statistics are those of the text as it stands, the features those of its look-alike form
    assert got[4].word_count == 100_000 and got[5].common_words == 0 and got[5].f_common == 0.5


def test_shape_of_an_empty_text_and_no_shape_for_null(spark, corpus):
    more = spark.createDataFrame([(900, ""), (901, None), (902, "  ")], "doc_id long, text string")
    got = {r.doc_id: r["shape"] for r in Q.document_shapes(corpus.select("doc_id", "text").unionByName(more), COMMON).collect()}
    assert got[900] == got[902] == "junk" and 901 not in got


def test_an_empty_table(spark):
    assert Q.document_shapes(spark.createDataFrame([], "doc_id long, text string"), COMMON).count() == 0


def test_every_iteration_raises_the_likelihood(spark, corpus):
    rows = Q.statistics(corpus, COMMON).drop(*Q.STATISTICS).cache()
    texts = spark.createDataFrame(shapes.examples(), "component string, shape string, text string")
    examples = Q.statistics(texts, COMMON, keep=("component", "shape")).toPandas()
    x = rows.toPandas()[Q.FEATURES].to_numpy(dtype=float)
    likes = [Q.fit(rows, examples, n).responsibilities(x)[1].mean() for n in (1, 3, 6)]
    assert likes[0] < likes[1] and likes[1] <= likes[2] + 1e-2
    r, _ = Q.fit(rows, examples, 2).responsibilities(x)
    assert np.allclose(r.sum(axis=1), 1)


def test_a_list_of_common_words_beyond_the_bound_is_refused(spark):
    table = spark.createDataFrame([("en", 1, "The"), ("de", 1, None), ("en", 2, "of")], "lang string, rank_no int, word string")
    assert Q.common_word_list(table) == ["of", "the"]
    with pytest.raises(ValueError):
        Q.common_word_list(table, 1)


def test_the_mixture_is_iterated_until_it_has_converged(spark, corpus):
    rows = Q.statistics(corpus, COMMON).drop(*Q.STATISTICS)
    texts = spark.createDataFrame(shapes.examples(), "component string, shape string, text string")
    examples = Q.statistics(texts, COMMON, keep=("component", "shape")).toPandas()
    likelihoods = Q.fit(rows, examples).likelihoods
    assert likelihoods[-1] - likelihoods[-2] < Q.LEAST_GAIN and all(b - a >= Q.LEAST_GAIN for a, b in zip(likelihoods[:-2], likelihoods[1:-1], strict=True))


@pytest.mark.parametrize(
    ("line", "cells"),
    [("a\tb", True), ("| a | b |", True), ("+---+--+", True), ("1;2;3", True), ("ok,12,n/a,4", True), ("name: value", True), ("left    right", True), ("We came, saw, and won the day at last.", False), ("One | two", False), ("A plain sentence.", False)],
)
def test_rows_of_cells(line, cells):
    assert Q._is_cells(line) is cells
