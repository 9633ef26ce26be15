"""Exact offset chunking and running sums, against plain Python."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import chunks, ordered
from tidemark.plans import skewed_spend

ROWS = [("hot", i) for i in range(500)] + [("warm", i) for i in range(60)] + [(None, i) for i in range(70)] + [("one", None)]


def frame(spark, rows=ROWS, parts=7):
    return spark.createDataFrame(rows, "k string, v long").repartition(parts)


def test_positions_are_exact_and_chunks_equal(spark):
    rows = chunks.chunked(chunks.numbered(frame(spark), ["k"], 50), "k").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.k].append((r["__position"], r["__chunk"]))
    for key in ("hot", "warm", None):
        assert sorted(p for p, _ in by[key]) == list(range(len(by[key])))
        assert all(c == p // 50 for p, c in by[key])
    sizes = Counter(c for _, c in by["hot"])
    assert set(sizes.values()) == {50}
    assert {c for _, c in by["one"]} == {0}


def test_totals_merge_states_in_order(spark):
    rows = chunks.numbered(frame(spark), ["k"], 50)
    states = {"c_n": F.count(F.lit(1)), "c_v": F.sum("v"), "c_last": F.max_by("v", "__position")}
    merges = {"n": F.sum("c_n"), "v": F.sum("c_v"), "last": F.max_by("c_last", "__chunk")}
    got = {r.k: (r.n, r.v) for r in chunks.totals(rows, "k", states, merges).collect()}
    assert got == {"hot": (500, sum(range(500))), "warm": (60, sum(range(60))), None: (70, sum(range(70))), "one": (1, None)}


def test_several_keys_are_numbered_at_once_and_other_columns_may_clash(spark):
    df = frame(spark).withColumn("n", F.col("v")).withColumn("k2", F.lit("same"))
    rows = chunks.numbered(df, ["k", "k2"], 100)
    got = chunks.chunked(rows, "k2").select("__position").orderBy("__position").collect()
    assert [r[0] for r in got] == list(range(len(ROWS)))


def test_an_empty_table(spark):
    rows = chunks.numbered(frame(spark, []), ["k"])
    assert chunks.totals(rows, "k", {"c": F.count(F.lit(1))}, {"n": F.sum("c")}).count() == 0
    assert ordered.running(frame(spark, []), "k", [F.col("v")], ["v"]).count() == 0


def test_offsets_are_joined_without_broadcast_too(spark, monkeypatch):
    monkeypatch.setattr(chunks, "broadcast_if_small", lambda side: side)
    rows = chunks.chunked(chunks.numbered(frame(spark), ["k"], 50), "k").filter("k = 'hot'").select("__position").collect()
    assert sorted(r[0] for r in rows) == list(range(500))


def test_running_sums_with_ties_nulls_and_repeated_rows(spark):
    data = [("a", i // 3, i % 4 or None, i) for i in range(200)] + [(None, 1, 5, 300), (None, 1, 6, 301), ("b", 0, None, 302)]
    df = spark.createDataFrame(data, "g string, o long, v long, i long").repartition(5)
    got = {r.i: r.before_v for r in ordered.running(df, "g", [F.col("o"), F.col("i")], ["v"]).collect()}
    totals = defaultdict(int)
    for g, _, v, i in sorted(data, key=lambda r: (r[0] or "", r[1], r[3])):
        assert got[i] == totals[g]
        totals[g] += v or 0


def test_running_sum_over_everything(spark):
    df = spark.range(0, 1000, 1, 6).withColumn("v", F.lit(2).cast("long"))
    got = {r.id: r.before_v for r in ordered.running(df, None, [F.col("id")], ["v"]).collect()}
    assert all(got[i] == 2 * i for i in range(1000))


def test_a_key_with_a_tenth_of_the_rows_is_split_by_default(spark):
    df = spark.createDataFrame([("hot" if i % 10 == 0 else f"k{i}", i) for i in range(5000)], "k string, v long").repartition(3)
    rows = chunks.numbered(df, ["k"])
    placed = chunks.chunked(rows, "k").filter("k = 'hot'")
    assert placed.select("__chunk").distinct().count() > 1
    assert sorted(r[0] for r in placed.select("__position").collect()) == list(range(500))
    got = chunks.totals(rows, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"rows": F.sum("n"), "states": F.count(F.lit(1)), "total": F.sum("s")})
    hot = got.filter("k = 'hot'").first()
    assert hot.rows == 500 and hot.states > 1 and hot.total == sum(range(0, 5000, 10))


def test_only_rows_of_hot_values_are_numbered(spark):
    got = chunks.numbered(frame(spark), ["k"], 65).rows.groupBy("k").agg(F.count("__no_k").alias("n")).collect()
    assert {r.k: r.n for r in got} == {"hot": 500, None: 70, "warm": 0, "one": 0}
    hot = chunks.hot_values(frame(spark).withColumn("k2", F.col("v") % 2), ["k", "k2"], 200)
    assert hot["k"] == ["hot"] and sorted(hot["k2"]) == [0, 1]


def test_steps_are_merged_over_the_borders_of_chunks(spark):
    values = [0, 5, 6, 20, 21, 22, 60, 61, 62, 63, 64, 100]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7), ("c", 1), ("c", 4), (None, 9), (None, 30)], "k string, v long").repartitionByRange(3, "v").sortWithinPartitions("v")
    for size in (2, 3, 5, 100):
        got = {r.k: (r.rows, r.gap) for r in chunks.longest_gaps(chunks.numbered(df, ["k"], size), "k", "v").collect()}
        assert got == {"a": (12, 38), "b": (1, None), "c": (2, 3), None: (2, 21)}


@pytest.mark.skipif(not Path(entry.DATA, "sf0.001").exists(), reason="the test tables aren't here")
def test_the_registered_queries_chunk_their_hot_keys(spark):
    rows = skewed_spend.spend_keys(spark, f"{entry.DATA}/sf0.001")
    for key in skewed_spend.KEYS:
        assert chunks.offsets(rows, key).count() > 0
        spread = chunks.chunked(rows, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("__chunk").alias("chunks")).orderBy(F.col("n").desc()).first()
        assert spread.n > rows.chunk_rows and spread.chunks == -(-spread.n // rows.chunk_rows)
