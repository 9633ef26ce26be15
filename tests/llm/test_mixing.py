"""Weighted fair queueing against a plain queue."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M

TARGETS = [("a", 0.5, 1), ("b-x", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 5), (None, 0.1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "one two three four " * (1 + i % 4), ("A ", "B X", "b-x", "c")[i % 4] if i % 7 else "a") for i in range(400)]
    rows += [(1000, None, "a"), (1001, "text", None), (1002, "text", "unknown"), (1003, "", "a"), (None, "text", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target_share", F.lit("clash")).repartition(4)


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_repeats_and_budget(docs, targets):
    served, report = M.select_mix(docs, targets)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"a", "b_x", "c"}
    total = sum(r.tokens for r in rows.values())
    assert total <= rows["a"].budget and rows["a"].budget - total < 40
    for r in rows.values():
        assert abs(r.share - r.target_share) < 0.01 and r.most_uses <= r.max_repeats
    uses = served.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("round").alias("r")).collect()
    assert all(u.n == u.r <= rows[u.source].max_repeats for u in uses)
    assert not {u.doc_id for u in uses} & {1000, 1001, 1002, None}


def test_sources_without_tokens_leave_the_others_their_mix(spark, docs):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b-x", 0.24, 2), ("c", 0.16, 3), ("gone", 0.1, 2), ("blank", 0.1, 4)], "source string, target_share double, max_repeats int")
    blank = spark.createDataFrame([(2000, "", "blank"), (2001, "", "blank")], "doc_id long, text string, source string").withColumn("target_share", F.lit("clash"))
    served, report = M.select_mix(docs.unionByName(blank), targets)
    rows = {r.source: r for r in report.collect()}
    assert {s for s, r in rows.items() if not r.reachable} == {"gone", "blank"} and rows["gone"].share == rows["blank"].share == 0
    assert rows["gone"].documents == 0 and rows["blank"].documents == 2
    for s, share in (("a", 0.5), ("b_x", 0.3), ("c", 0.2)):
        assert abs(rows[s].share - share) < 0.01 and rows[s].most_uses <= rows[s].max_repeats
    total = sum(r.tokens for r in rows.values())
    assert 0 <= rows["a"].budget - total < 40 and total > 1000


def test_same_as_a_plain_queue_at_a_budget_beyond_some_source(docs, targets):
    queue, sources = M.queue(docs, targets)
    everything = sorted((r.finish, r.source, r.round, r.doc_id, r.tokens) for r in queue.collect())
    budget = M.reachable(sources) + 500
    expected, used = [], 0
    for _, source, n, doc, tokens in everything:
        if used + tokens > budget:
            break
        used += tokens
        expected.append((doc, source, n))
    served, report = M.select_mix(docs, targets, budget)
    assert sorted((r.doc_id, r.source, r.round) for r in served.collect()) == sorted(expected)
    assert sum(r.tokens for r in report.collect()) == used


def test_finish_times_are_served_tokens_over_share(docs, targets):
    queue, sources = M.queue(docs, targets)
    total = {r.source: r.total for r in sources.collect()}
    served: dict = {}
    for r in sorted(queue.collect(), key=lambda r: (r.source, r.finish, r.round, r.tokens)):
        served[r.source] = served.get(r.source, 0) + r.tokens
        share = {"a": 0.5, "b_x": 0.3, "c": 0.2}[r.source]
        if r.tokens:
            assert abs(r.finish - served[r.source] / share) < 1e-6
    assert served == {s: t * {"a": 1, "b_x": 2, "c": 3}[s] for s, t in total.items()}


def test_the_seed_shuffles_and_repeats(docs, targets):
    first = [sorted(r.doc_id for r in M.select_mix(docs, targets, 500, seed)[0].collect()) for seed in (1, 1, 2)]
    assert first[0] == first[1] != first[2]


def test_empty_tables(spark, docs, targets):
    served, report = M.select_mix(docs.filter("false"), targets)
    assert served.count() == 0 and [r.tokens for r in report.collect()] == [0, 0, 0]
    assert M.select_mix(docs, targets.filter("false"))[0].count() == 0


def test_tokens_of_long_texts_nulls_and_special_strings(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>"), (5, "word " * 60_000), (6, "x" * 250_000)]
    got = {r.id: r.n for r in spark.createDataFrame(rows, "id int, t string").select("id", M.token_count("t").alias("n")).collect()}
    assert got[1] is None and got[2] == 0 and got[3] == 2 and got[4] > 1 and abs(got[5] - 60_001) < 10 and got[6] > 1000


def test_pruned_uses_hold_everything_that_is_served(docs, targets):
    summed, sources = M.sizes(docs, targets)
    for budget in (0, 10, 300, M.reachable(sources), 10**9):
        until = M.last_time(sources, budget)
        order = lambda rows: sorted((r.finish, r.source, r.round, r.doc_id, r.tokens) for r in rows.collect())
        everything, kept = order(M.uses(summed, sources)), order(M.uses(summed, sources, until))
        used, served = 0, []
        for row in everything:
            used += row[-1]
            if used > budget:
                break
            served.append(row)
        assert kept[: len(served)] == served
        assert until is None or len(kept) < len(everything) or budget > 300


def test_long_texts_have_the_tokenizers_own_count(spark):
    encode = M._encoding(f"{M.TOKENIZER_DIR}/{M.VOCABULARY}").encode_ordinary
    texts = ["word " * 5 + "abcdefgh" * 30_000 + " end", " " * 200_001 + "x", "eins zwei, drei 4 " * 15_000, "é" * 120_000, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.token_count("t").alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: len(encode(t)) for i, t in enumerate(texts)}
