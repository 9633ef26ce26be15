"""Look-alike classes: what must become one and what must stay apart."""

import json
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import lookalike_queries as Q
from tidemark.llm import lookalikes as L

REWRITE = L.default_rewriter().rewrite


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｓｅｅ　８", "see 8"), ("ﬁnance oﬃce", "finance office"), ("é", "é"), ("a​b⁠c﻿­", "abc"), ("a b c ", "a b c "),
        ("Асtіоn", "Action"), ("ϲοѕt", "cost"), ("с̧", "ç"), ("e‍́", "é"), ("645‑964", "645-964"), ("𝐛𝐨𝐥𝐝", "bold"), ("Ⅷ", "VIII"),
    ],
)
def test_looks_the_same(a, b):
    assert REWRITE(a) == REWRITE(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("é", "e"), ("1", "l"), ("0", "O"), ("2º", "2o"), ("x²", "x2"), ("ß", "ss"), ("Ł", "L"), ("ø", "o"), ("I", "l"), ("word", "world")])
def test_looks_different(a, b):
    assert REWRITE(a) != REWRITE(b)


@given(st.text(st.sampled_from("aéе̧́​ﬁｅ ç СI"), max_size=12))
def test_a_second_rewrite_changes_nothing(text):
    once = REWRITE(text)
    assert REWRITE(once) == once


@given(st.text(st.sampled_from("aéе́​ﬁｅb"), max_size=12))
def test_alignment_points_into_the_text(text):
    form, source = L.default_rewriter().aligned(text)
    assert len(form) == len(source) and source == sorted(source)
    assert unicodedata.normalize("NFC", form) == REWRITE(text)


def test_union_find_is_transitive_and_frequencies_choose():
    classes = L.Classes([("x", "y"), ("y", "z"), ("q", "")])
    assert sorted(map(tuple, classes.members())) == [("", "q"), ("x", "y", "z")]
    assert L.rewrites(classes, {"z": 5, "x": 2}) == {"x": "z", "y": "z", "q": ""}
    assert L.rewrites(classes, {})["y"] == "x"


def test_ascii_texts_take_the_form_of_a_more_frequent_look_alike():
    rewrite = L.default_rewriter((("‹", 9), ("<", 1), ("о", 9), ("o", 2), ("ﬁ", 9), ("fi", 1))).rewrite
    assert rewrite("a < b") == rewrite("a ‹ b") == "a ‹ b"
    assert rewrite("cost") == rewrite("cоst") == "cоst" and rewrite("fine") == rewrite("ﬁne") == "ﬁne"


def test_frequencies_count_joined_letters_in_ascii_texts(spark):
    assert dict(L.frequencies(spark.createDataFrame([("fine fig",), ("ﬁ é",)], "t string"), "t"))["fi"] == 2


def test_frequencies_count_all_rows(spark):
    df = spark.createDataFrame([("éá",), (None,), ("",), ("ее",)], "t string").repartition(3)
    counts = dict(L.frequencies(df, "t"))
    assert counts["é"] == 1 and counts["á"] == 1 and counts["е"] == 2


def test_canonical_of_nulls_empty_and_long_texts(spark):
    long = "ｅ" * 300_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", L.canonical("t").alias("c")).collect()}
    assert got == {1: None, 2: "", 3: "e" * 300_000}


def test_pairs_of_spellings_not_of_copies(spark):
    rows = [("a", "f", "1"), ("b", "f", "1"), ("c", "f", "2"), ("d", "g", "3"), ("e", "g", "3"), ("c", "f", "2"), (None, "f", "9"), ("z", None, None)]
    df = spark.createDataFrame(rows, "key string, form string, same string")
    assert sorted(map(tuple, Q.alike_pairs(df, []).collect())) == [("a", "c"), ("b", "c")]
    assert Q.alike_pairs(df.filter("false"), []).count() == 0


def test_requests_agree_in_everything_else(spark):
    base = {"kind": "llm", "model": "m", "messages": [{"role": "user", "content": [{"type": "text", "text": "cost"}, {"content": [{"text": "x y"}]}]}, {"role": "tool", "content": None}], "stream": True}
    alike = json.loads(json.dumps(base).replace("cost", "ϲοѕt").replace("x y", "x y"))
    other_model = alike | {"model": "n"}
    no_stream = alike | {"stream": False}
    rows = [(json.dumps(r), v) for r in (base, alike, other_model, no_stream) for v in (1, 2)] + [("{", 1), (None, 2)]
    df = spark.createDataFrame(rows, "r string, v int").coalesce(1)
    parts = df.select(F.lit("llm").alias("tbl"), F.col("v").alias("version"), F.monotonically_increasing_id().cast("string").alias("key"), Q.request_parts("r", "v").alias("p"))
    assert parts.select("p.texts").first().texts == ["cost", "x y"]
    by_key = {r.key: r for r in Q.forms(parts.select("tbl", "version", "key", "p.*")).collect()}
    assert set(by_key) == {str(i) for i in range(8)}  # the unreadable and the null request have no form
    got = [by_key[str(i)] for i in range(8)]
    base1, base2, alike1, alike2, other1, other2, stream1, stream2 = got[:8]
    assert base1.form == alike1.form == stream1.form and base1.same != alike1.same == stream1.same
    assert base2.form == alike2.form != stream2.form and other1.form != base1.form and other2.form != base2.form


def test_classes_count_spellings_and_distinct_keys(spark):
    rows = [("a", "f", "1"), ("b", "f", "1"), ("c", "f", "2"), ("d", "g", "3"), ("e", "g", "3"), ("c", "f", "2")]
    df = spark.createDataFrame(rows, "key string, form string, same string")
    assert sorted(map(tuple, Q.classes(df, []).collect())) == [("f", 2, 3), ("g", 1, 2)]


def test_rules_are_followed_to_their_end_or_refused():
    chain = {f"<{i}>": f"<{i + 1}>" for i in range(30)}
    assert L.Rewriter(chain).rewrite("<0>") == "<30>" and set(L._closed(chain).values()) == {"<30>"}
    marks = "e" + "\u200b" * 50 + "\u0301"
    assert REWRITE(marks) == "é"
    with pytest.raises(ValueError, match="circle"):
        L.Rewriter({"a": "b", "b": "a"}).rewrite("a")
