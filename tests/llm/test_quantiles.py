"""Dyadic Count-sketches against sorted values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quantiles as Q
from tidemark.llm.quantile_queries import latency, model_name

#: Half a cell of the code, as a share of the value.
CELL = 2.0 ** -(Q.FRACTION + 1) * 1.001
QS = [0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def sample(n, seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.lognormal(5, 1, n // 2), rng.normal(300, 4, n // 4), rng.lognormal(9, 2, n - n // 2 - n // 4)])


def check(values, got):
    values = np.sort(values)
    for r in got:
        target = max(1, math.ceil(r.q * len(values)))
        width = abs(r.value) * 2.0**-Q.FRACTION
        low, high = np.searchsorted(values, r.value - width, "left") + 1, np.searchsorted(values, r.value + width, "right")
        off = 0 if low <= target <= high else min(abs(low - target), abs(high - target))
        assert off <= r.rank_error * len(values) + 1e-9, r
        assert r.n == len(values)


def test_codes_keep_order_and_precision(spark):
    values = sorted([0.0, -0.0, 1e-300, 1.5, -2.25, 7e8, -3e-9, 4095.99, 4096.0, 2**52 + 1.0, 1e308, -1e308, *sample(2000).tolist()])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", Q.encode(F.col("v")).alias("c")).collect()
    codes = [r.c for r in sorted(rows, key=lambda r: r.v)]
    assert codes == sorted(codes) and 0 <= codes[0] and codes[-1] < 2**Q.BITS
    for r in rows:
        assert r.v == 0 or abs(Q.decode(r.c) - r.v) <= abs(r.v) * 2.0 ** -(Q.FRACTION + 1) * 1.001


def test_ranks_are_within_the_stated_error(spark):
    values = sample(40_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("g", F.lit("x")).repartition(5)
    check(values, Q.percentiles(Q.sketch(df, ["g"], "v"), ["g"], QS).collect())


def test_parts_and_days_merge_to_the_same_sketch_and_values_can_be_deleted(spark):
    values = sample(4000)
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, day int").withColumn("g", F.lit("x"))
    whole = Q.sketch(df, ["g"], "v")
    days = Q.merge(Q.sketch(df, ["g", "day"], "v"), ["g"])
    plain = lambda sketch: sorted(map(tuple, Q.counters(sketch, ["g"]).collect()))
    assert plain(whole) == plain(days)
    minus = df.filter("day = 0").withColumn("w", F.lit(-1)).unionByName(df.withColumn("w", F.lit(1)))
    kept = Q.sketch(df.filter("day <> 0"), ["g"], "v")
    assert plain(Q.sketch(minus, ["g"], "v", "w")) == plain(kept)
    assert Q.percentiles(Q.sketch(df.withColumn("w", F.lit(0)), ["g"], "v", "w"), ["g"], QS).count() == 0


def test_a_sketch_is_bounded(spark):
    df = spark.range(200_000).select(F.lit("x").alias("g"), (F.rand(1) * 1e6).alias("v"))
    sketch = Q.sketch(df, ["g"], "v")
    assert Q.counters(sketch, ["g"]).count() <= Q.MAX_COUNTERS and sketch.count() <= Q.TABLE_ROWS


def test_counters_are_sums_over_all_values_whatever_a_task_holds(spark, monkeypatch):
    values = sample(3000)
    df = spark.createDataFrame([(f"g{i % 5}", float(v)) for i, v in enumerate(values)], "g string, v double")
    want: dict = {}
    for g, code in df.select("g", Q.encode(F.col("v"))).collect():
        for level in range(Q.BITS + 1):
            x = code >> level
            for row, (a, b, c, d) in enumerate(Q.CONSTANTS[level] if level <= Q.FIRST_SKETCHED else [(1, 0, 0, 0)]):
                key = (g, level, row, (a * x + b) % Q.PRIME % Q.WIDTH if level <= Q.FIRST_SKETCHED else x)
                want[key] = want.get(key, 0) + (1 - 2 * ((c * x + d) % Q.PRIME % 2) if level <= Q.FIRST_SKETCHED else 1)
    want = {k: n for k, n in want.items() if n}
    parts = [Q._Partial(["g"]) for _ in range(2)]
    coded = df.select("g", Q.encode(F.col("v")).alias("__code"), F.lit(1).cast("long").alias("__w")).toPandas()
    got: dict = {}
    monkeypatch.setattr(Q, "GROUPS_AT_ONCE", 2)
    for part, rows in zip(parts, (coded[:1000], coded[1000:]), strict=True):
        part.add(rows[:300])
        part.add(rows[300:])
        for frame in part.counters():
            for g, level, row, buckets, counts in frame.itertuples(index=False):
                for b, n in zip(buckets, counts, strict=True):
                    got[g, level, row, b] = got.get((g, level, row, b), 0) + n
    assert {k: n for k, n in got.items() if n} == want
    direct = {(r.g, r.level, r.row, r.bucket): r.n for r in Q.counters(Q.sketch(df.repartition(3), ["g"], "v"), ["g"]).collect()}
    assert direct == want


def test_the_stated_error_is_close_to_the_real_one(spark):
    values = sample(40_000, 8)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("g", F.lit("x"))
    got = Q.percentiles(Q.sketch(df, ["g"], "v"), ["g"], [i / 100 for i in range(1, 100)]).collect()
    check(values, got)
    assert got[0].rank_error < 0.015


def test_nulls_infinities_ties_empty_tables_and_clashing_columns(spark):
    rows = [(None, 5.0)] * 4 + [("a", None), ("a", float("nan")), ("a", float("inf")), ("a", -2.0), ("a", -2.0), ("a", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("level", F.lit(9)).withColumn("n", F.lit("x"))
    got = {(r.g, r.q): (r.n, r.value) for r in Q.percentiles(Q.sketch(df, ["g"], "v"), ["g"], [0.5, 1.0]).collect()}
    assert got[None, 0.5] == (4, pytest.approx(5.0, rel=CELL)) and got["a", 0.5] == (3, pytest.approx(-2.0, rel=CELL)) and got["a", 1.0] == (3, 0.0)
    assert Q.percentiles(Q.sketch(df.filter("false"), ["g"], "v"), ["g"], QS).count() == 0


def test_dirty_latencies_and_models(spark):
    texts = ["12.5", "197 ms", "1.5 s", "-1.0", "x", None, "", "1e2", "12 kg"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(latency(F.col("t"))).collect()]
    assert got == [12.5, 197.0, 1500.0, None, None, None, None, 100.0, None]
    models = spark.createDataFrame([(" GW/Quillon-4 ",), (None,)], "m string").coalesce(1).select(model_name(F.col("m"))).collect()
    assert [r[0] for r in models] == ["quillon-4", None]


def test_values_are_exact_to_a_part_in_five_thousand():
    assert Q.FRACTION == 12 and Q.BITS == 24
    for v in (1.0001, 3.0, 1234.567, -7.7e-5):
        e = int(np.floor(np.log2(abs(v))))
        cell = (e + 1022) * (1 << Q.FRACTION) + int((abs(v) / 2.0**e - 1) * (1 << Q.FRACTION)) + 1
        assert Q.decode(Q.HALF + cell if v > 0 else Q.HALF - cell) == pytest.approx(v, rel=2.0**-13 * 1.001)
