"""Leak search against a scan of all word runs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.leaks import WordSearch, leaks, words_of


def brute(text, passages, span):
    words = words_of(text)
    runs = {tuple(words[i : i + span]) for i in range(len(words) - span + 1)}
    out = set()
    for item, passage in passages:
        p = words_of(passage)
        if any(tuple(p[i : i + span]) in runs for i in range(len(p) - span + 1)):
            out.add(item)
    return out


words = st.lists(st.sampled_from("a b c d".split()), max_size=30).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(words, st.lists(words, max_size=4), st.integers(2, 5))
def test_same_as_a_scan_of_all_runs(text, passages, span):
    numbered = list(enumerate(passages))
    assert set(WordSearch(numbered, span).leaks(text)) == brute(text, numbered, span)


def test_longest_run_case_punctuation_and_letters(spark):
    passage = "Eins zwei, drei; VIER fünf sechs sieben acht neun zehn elf zwölf"
    texts = [
        (1, "x y eins ZWEI drei - vier (fünf) sechs_sieben acht neun zehn ende"),
        (2, "eins zwei drei vier fünf sechs sieben acht neun"),
        (3, None),
        (4, ""),
        (5, "w " * 200_000 + passage),
        (6, passage),
        (6, passage),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, passage), (8, passage), (9, "too short"), (10, None), (None, passage)], "item_id long, passage string")
    got = sorted(map(tuple, leaks(docs, items).collect()))
    assert got == sorted([(1, 7, 2, 10), (1, 8, 2, 10), (5, 7, 200_000, 12), (5, 8, 200_000, 12)] + [(6, 7, 0, 12), (6, 8, 0, 12)] * 2)


def test_many_passages_are_searched_by_hash(spark):
    passages = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(20)]
    items = spark.createDataFrame(passages, "item_id long, passage string")
    docs = spark.createDataFrame([(i, f"a b {p} c") for i, p in passages], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items, pass_chars=200).collect()) == [(i, i) for i in range(20)]


def test_both_ways_find_the_same(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = spark.createDataFrame([*((i % 9, some(rng.randint(0, 30))) for i in range(12)), (3, None), (None, some(20))], "item_id long, passage string")
    docs = spark.createDataFrame([*((i // 2, some(rng.randint(0, 300))) for i in range(30)), (99, None), (98, "")], "doc_id long, text string")
    for span in (3, 6):
        one, other = (sorted(map(tuple, leaks(docs, items, span, chars).collect())) for chars in (10**6, 1))
        assert one == other and one


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert leaks(docs, items).count() == 0
    assert leaks(spark.createDataFrame([(1, "a b")], docs.schema), items).count() == 0
