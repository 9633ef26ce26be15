"""Spend reports, budgets and streams against plain Python."""

import datetime as dt
import json
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.operators import spend as op
from tidemark.storage import dropped, shared_dir, written
from tidemark.streaming import stateful

SCHEMA = "spend_id long, ts timestamp_ntz, logged_at timestamp_ntz, model string, tags map<string,string>, usd decimal(18,9), input_tokens long, output_tokens long, reasoning_tokens long, calls int, unpriced boolean"
T0 = dt.datetime(2026, 1, 1)


def row(i, key, usd, ts=None, logged=0, unpriced=False, model="m"):
    tags = None if key is None else {"user_id": key} if key else {}
    return (i, T0 + dt.timedelta(seconds=i if ts is None else ts), T0 + dt.timedelta(days=logged), model, tags, None if usd is None else Decimal(usd), 1, None, 2, 1, unpriced)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [row(i, "hot" if i % 3 else f"u{i % 9}", f"0.0{i % 7}", ts=i // 4) for i in range(400)]
    rows += [row(400, None, "1"), row(401, "", "2"), row(402, "hot", None, unpriced=True), row(5, "hot", "9", logged=1), row(403, "none", "0.5", model=None)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).repartition(5)


def test_reports_have_null_keys_and_count_unpriced_calls(spark, facts):
    got = {r.user_id: r for r in op.report(facts.drop("key"), ["user_id"]).collect()}
    assert got[None].usd == Decimal(3) and got["hot"].unpriced_calls == 1 and got["none"].tokens == 1
    assert op.report(facts.filter("false"), []).count() == 0 and op.report(facts, []).first().calls == 405


def test_under_fails_only_above_the_cap(spark):
    df = spark.createDataFrame([row(1, "a", "0.5"), row(2, "a", "0.5"), row(3, "b", "7")], SCHEMA)
    assert op.under(df, "1.0", {"user_id": "a"}).first().ok and not op.under(df, "0.999999999", {"user_id": "a"}).first().ok
    assert op.under(df, "0", {"user_id": "zzz"}).first().usd == 0


def ordered_calls(facts):
    calls = defaultdict(list)
    for r in sorted(op.once(facts.drop("key")).collect(), key=lambda r: (r.ts, r.spend_id)):
        calls[(r.tags or {}).get("user_id")].append((r.spend_id, r.usd or Decimal(0)))
    return calls


def test_running_spend_first_breach_and_newest(facts):
    once = op.once(facts.drop("key"))
    running = op.running_spend(once, op.tag("user_id"), "user_id")
    got = {r.spend_id: (r.spent_usd, r.spent_calls) for r in running.collect()}
    breach = {r.user_id: r.spend_id for r in op.first_breach(running, "user_id", "0.1").collect()}
    newest = defaultdict(set)
    for r in op.newest(once, op.tag("user_id"), 3, "user_id").collect():
        newest[r.user_id].add(r.spend_id)
    for key, calls in ordered_calls(facts).items():
        total, first = Decimal(0), None
        for n, (i, usd) in enumerate(calls, 1):
            total += usd
            assert got[i] == (total, n)
            first = i if first is None and total > Decimal("0.1") else first
        assert breach.get(key) == first
        assert newest[key] == {i for i, _ in calls[-3:]}


@pytest.mark.parametrize(("cap", "rounds"), [("0.07", 12), ("0.5", 12), ("100", 12), ("0", 12), ("0.07", 1), ("0.5", 0)])
def test_enforced_calls_don_t_accrue_when_blocked(facts, monkeypatch, cap, rounds):
    monkeypatch.setattr(op, "ROUNDS", rounds)
    got = {r.spend_id: r.allowed for r in op.enforced(op.once(facts.drop("key")), op.tag("user_id"), cap, "user_id").collect()}
    assert len(got) == 404
    for calls in ordered_calls(facts).values():
        spent = Decimal(0)
        for i, usd in calls:
            ok = spent + usd <= Decimal(cap)
            spent += usd if ok else 0
            assert got[i] is ok, (i, usd, spent)


def test_alternating_tiny_and_full_calls_end_after_a_few_rounds(spark):
    calls = [row(i, "k", "0.000000001" if i % 2 else "0.999999999") for i in range(300)]
    allowed = op.enforced(spark.createDataFrame(calls, SCHEMA), op.tag("user_id"), "1", "user_id")
    assert sorted(r.spend_id for r in allowed.filter("allowed").collect()) == [0, 1]


def test_outputs_are_clamped_to_what_is_left(spark):
    rows = [(1, "a", T0, 10, 50), (2, "a", T0, 10, 50), (3, "a", T0, 5, 1), (4, "b", T0, 100, 1), (5, "b", T0, None, 7), (6, None, T0, 99, None)]
    df = spark.createDataFrame(rows, "spend_id long, key string, ts timestamp_ntz, input long, output long")
    got = {r.spend_id: (r.action, r.output) for r in op.clamped(df, 100).collect()}
    assert got == {1: ("allowed", 50), 2: ("clamped", 30), 3: ("blocked", 0), 4: ("blocked", 0), 5: ("allowed", 7), 6: ("allowed", 0)}


def test_newest_by_either_way(spark, facts, monkeypatch):
    rows = lambda: sorted((r.user_id or "", r.spend_id) for r in op.newest(op.once(facts.drop("key")), op.tag("user_id"), 3, "user_id").collect())
    limited = rows()
    monkeypatch.setattr(op, "GROUP_LIMIT", 0)
    assert rows() == limited


def test_tables_in_the_shared_folder(spark):
    table = written(spark.range(5), "t")
    assert table.count() == 5 and shared_dir(spark)
    dropped(table)
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.parquet(table.inputFiles()[0]).count()


def stream(spark, tmp_path, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streamed_budgets_keep_their_state(spark, tmp_path):
    rows = [("a", i, T0 + dt.timedelta(seconds=i), Decimal("0.1")) for i in range(20)] + [("b", 99, T0, None)]
    calls = stream(spark, tmp_path, rows, "key string, call_id long, ts timestamp_ntz, usd decimal(18,9)")
    stateful.run_available(stateful.budgets(calls, "0.7"), stateful.append_table(str(tmp_path / "out")), "b")
    got = spark.read.parquet(str(tmp_path / "out/*")).collect()
    assert sum(r.allowed for r in got if r.key == "a") == 7 and len(got) == 21
    assert max(r.spent for r in got) == Decimal("0.700000000")


def test_streamed_calls_are_put_together_once(spark, tmp_path):
    rows = [("x", i, t, i == 2) for i, t in enumerate("abc")] + [("x", 1, "b", False)] + [("long", i, "z" * 50, False) for i in range(3)]
    chunks = stream(spark, tmp_path, rows, "call_id string, idx int, text string, last boolean", 1)
    stateful.run_available(stateful.calls_from_chunks(chunks, idle_ms=60_000, max_tokens=20), stateful.append_table(str(tmp_path / "out")), "c", idle_ms=60_000 // 200)
    got = {r.call_id: (r.text, r.broken) for r in spark.read.parquet(str(tmp_path / "out/*")).collect()}
    assert got == {"x": ("abc", False), "long": ("z" * 150, True)}


def test_open_calls_are_emitted_at_the_end_of_input_and_late_chunks_open_none_again(spark, tmp_path):
    schema = "call_id string, idx int, text string, last boolean"
    chunks = stream(spark, tmp_path, [("open", 0, "a", False), ("open", 1, "b", False), ("done", 0, "c", True)], schema, 1)
    calls = stateful.calls_from_chunks(chunks, idle_ms=1500)
    late = {"written": False}

    def sink(batch, batch_id):
        stateful.append_table(str(tmp_path / "out"))(batch, batch_id)
        if not late["written"] and any(r.call_id == "open" for r in batch.collect()):
            late["written"] = True
            spark.createDataFrame([("open", 2, "late", True), ("done", 1, "late", True)], schema).write.mode("append").parquet(str(tmp_path / "in"))

    stateful.run_available(calls, sink, "open", idle_ms=1500)
    got = [(r.call_id, r.text) for r in spark.read.parquet(str(tmp_path / "out/*")).collect()]
    assert late["written"] and sorted(got) == [("done", "c"), ("open", "ab")]


def test_windowed_counters(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=m), "k", 1) for m in (1, 2, 11, 300)]
    events = stream(spark, tmp_path, rows, "ts timestamp_ntz, key string, tokens long", 1).withColumn("ts", F.col("ts").cast("timestamp"))
    stateful.run_available(stateful.counters(events), stateful.append_table(str(tmp_path / "out")), "w")
    assert sorted((r.start.hour, r.start.minute, r.n) for r in spark.read.parquet(str(tmp_path / "out/*")).collect())[:2] == [(0, 0, 2), (0, 10, 1)]


def test_chain_writer_resumes_and_repeats(spark, tmp_path):
    write = stateful.chain_writer(str(tmp_path / "chain"))
    batch = lambda *ts: spark.createDataFrame([(t, "note", json.dumps({"t": t})) for t in ts], "ts string, type string, payload string")
    write(batch("1", "2"), 0)
    write(batch("3"), 1)
    write(batch("3"), 1)
    lines = [x for f in sorted((tmp_path / "chain").glob("*.jsonl")) for x in f.read_text().splitlines()]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "chain_id string, line_no int, line string")
    assert tuple(ledger.verify(df).first())[1:4] == (True, "ok", 3)


def test_fan_out_runs_every_sink_then_raises(spark):
    seen = []

    def bad(df, i):
        raise ValueError("first")

    with pytest.raises(ValueError, match="first"):
        stateful.fan_out(bad, lambda df, i: seen.append(i))(spark.range(1), 4)
    assert seen == [4]
