"""Ledgers and recordings, with known vectors and tampering."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import ingest, ledger, replay


def chain(payloads, key=None, meta=True):
    """Lines of an intact ledger."""
    lines, prev = [], ledger.GENESIS
    for i, p in enumerate(payloads):
        own = ledger.entry_hash(prev, i, f"t{i}", "note", p)
        row = {"seq": i, "ts": f"t{i}", "type": "note", "payload": p, "prev_hash": prev, "hash": own}
        if key:
            row["sig"] = ledger.signature(key, own)
        lines.append(json.dumps(row))
        prev = own
    if meta:
        head = {"system": "s", "risk_tier": None, "head_hash": prev, "entries": len(payloads)}
        if key:
            head["sig"] = ledger.header_signature(key, head)
        lines.insert(0, json.dumps({"_meta": head}))
    return lines


def verified(spark, chains, key=None):
    rows = [(c, i, line) for c, lines in chains.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "chain_id string, line_no int, line string")
    return {r.chain_id: (r.ok, r.detail) for r in ledger.verify(df, key).collect()}


PAYLOADS = [{"a": 1, "b": 2.0, "é": ["ü", None]}, {"text": 'quote " and \n'}, {}, {"z": {"y": [1e-7, -0.0]}}]


def test_intact_tampered_broken_cut_and_incomplete(spark):
    good = chain(PAYLOADS)
    tampered = [x.replace('"a": 1', '"a": 2') for x in good]
    removed = good[:2] + good[3:]
    cut = [*good[:3], good[3][:30], *good[4:]]
    short = good[:-1]
    missing = [*good[:2], json.dumps({"seq": 9})]
    got = verified(spark, {"good": good, "bare": chain(PAYLOADS, meta=False), "tampered": tampered, "removed": removed, "cut": cut, "short": short, "missing": missing, "blank": [*good, "", "  "], None: good})
    assert got["good"] == got["bare"] == got["blank"] == got[None] == (True, "ok")
    assert got["tampered"] == (False, "hash mismatch at seq 0")
    assert got["removed"] == (False, "broken link at seq 2: prev_hash mismatch")
    assert got["cut"] == (False, "corrupt log: unreadable line")
    assert got["short"] == (False, "incomplete log: head differs")
    assert got["missing"][1] == "corrupt log: missing 'ts'"


def test_signatures(spark):
    good = chain(PAYLOADS, "k")
    unsigned = chain(PAYLOADS)
    got = verified(spark, {"good": good, "unsigned": unsigned}, "k")
    assert got["good"] == (True, "ok")
    assert got["unsigned"] == (False, "bad signature at seq 0")
    assert verified(spark, {"good": good}, "other")["good"][0] is False


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.text(max_size=4), st.text(max_size=6) | st.integers() | st.none(), max_size=4), st.dictionaries(st.text(max_size=4), st.integers(), max_size=3))
def test_another_payload_has_another_hash(a, b):
    same = ledger.canonical_text(a) == ledger.canonical_text(b)
    assert (ledger.entry_hash("p", 0, "t", "x", a) == ledger.entry_hash("p", 0, "t", "x", b)) is same


def test_integers_and_floats_stay_apart():
    assert ledger.canonical_text({"b": 2.0, "a": 2, "é": "ü"}) == '{"a":2,"b":2.0,"é":"ü"}'


def test_chain_hash_of_columns_is_that_of_values(spark):
    rows = [(ledger.GENESIS, i, f"t\"{i}é", "note", json.dumps(p)) for i, p in enumerate(PAYLOADS)]
    df = spark.createDataFrame(rows, "prev string, seq long, ts string, type string, payload string")
    got = df.select("seq", ledger.chain_hash(*map(F.col, df.columns)).alias("h")).collect()
    for r in got:
        assert r.h == ledger.entry_hash(ledger.GENESIS, r.seq, f"t\"{r.seq}é", "note", PAYLOADS[r.seq])


def test_request_hash_versions_and_tools(spark):
    request = {"kind": "llm", "provider": "p", "model": "m", "messages": [], "stream": True}
    rows = [(json.dumps(request), 1), (json.dumps(request | {"stream": False}), 1), (json.dumps(request), 2), (None, 2), ("{", 2)]
    df = spark.createDataFrame(rows, "r string, v int")
    got = [r[0] for r in df.coalesce(1).select(replay.request_hash("r", "v")).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None and got[4] is None
    assert replay.tool_arguments({"x": 1}) == {"args": [], "kwargs": {"x": 1}}
    assert replay.tool_arguments([1]) == {"args": [1], "kwargs": {}}
    assert replay.tool_arguments({"args": [1]}) == {"args": [1], "kwargs": {}}
    assert replay.tool_arguments(3) == {"args": [3], "kwargs": {}}


def test_match_is_first_in_first_out(spark):
    recorded = spark.createDataFrame([("h", 1), ("h", 2)], "request_hash string, at int")
    live = spark.createDataFrame([("h", 5), ("h", 6), ("h", 7), ("x", 8)], "request_hash string, at int")
    got = {r.at: (r.rec_at, r.found) for r in replay.match(recorded, live, ["at"]).collect()}
    assert got == {5: (1, True), 6: (2, True), 7: (None, False), 8: (None, False)}


def test_promote_skips_what_is_no_call(spark):
    lines = ["", None, "{bad", '{"_meta": 1}', '{"kind": "other"}', '{"kind": "llm", "request": {"a": 1}, "response": "x"}', '{"kind": "tool", "request": 2, "result": 3}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted(map(tuple, replay.promote(df).collect())) == [("llm", '{"a":1}', "x"), ("tool", "2", "3")]


@pytest.mark.parametrize(
    ("response", "provider", "usage", "text"),
    [
        ('{"usage": {"prompt_tokens": 3, "completion_tokens": 4}, "choices": [{"message": {"content": "hi"}}]}', "some host", (3, 4, 0, 0, 0, 7), "hi"),
        ('{"usage": {"input_tokens": 3, "output_tokens": null, "cache_read_input_tokens": 2}, "content": [{"text": "yo"}]}', "anthropic", (5, 0, 2, 0, 0, 5), "yo"),
        ('[{"choices": [{"delta": {"content": "a"}}]}, {"choices": [{"delta": {"content": "b"}}], "usage": {"prompt_tokens": 1}}]', None, (1, 0, 0, 0, 0, 1), "ab"),
        ('{"usage": {"prompt_tokens": "x"}}', "openai", None, None),
        ('{"usage": {"prompt_tokens": 1}} and more', "openai", None, None),
        (None, "openai", None, None),
        ("{", None, None, None),
    ],
)
def test_responses(spark, response, provider, usage, text):
    row = spark.createDataFrame([(response, provider)], "r string, p string").select(ingest.usage(F.col("r"), F.col("p")).alias("u"), ingest.text(F.col("r")).alias("t")).first()
    assert (tuple(row.u) if row.u else None) == usage
    assert row.t == text


def test_roots_of_trees_cycles_and_unknown_parents(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone"), ("f", "e"), ("s", "s"), ("x", "y"), ("y", "x"), ("b", "a"), (None, "a")]
    got = {r.run: (r.root, r.depth) for r in ingest.roots(spark.createDataFrame(rows, "run string, parent string"), "run", "parent", rounds=8).collect()}
    assert {k: got[k] for k in "abcdefs"} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "e": ("e", 0), "f": ("e", 1), "s": ("s", 0)}
    assert got["x"][0] == "x" and got["y"][0] == "y"


def test_controls_of_types_categories_and_groups(spark):
    lines = [
        '{"type": "policy_flag", "payload": {"data": ["email", "iban", "email"]}}', '{"type": "policy_flag", "payload": {"data": "iban"}}', '{"type": "llm_call"}', '{"type": "none"}', "{", None,
        '{"type": "policy_flag", "payload": {}}',
    ]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "chain_id string, line_no int, line string")
    got = ledger.mapped_controls(df, {"policy_flag": ["a"], "llm_call": ["l", "m"]}, {"email": ["e", "a"], "financial": ["f"]}, groups={"iban": "financial", "email": "pii"})
    assert [r.controls for r in got.orderBy("line_no").collect()] == [["a", "e", "f"], ["a", "f"], ["l", "m"], [], [], [], ["a"]]


def test_evidence_packs_can_be_written_and_verified(spark, tmp_path):
    prev, lines = ledger.GENESIS, []
    for seq, kind in enumerate(("audit_open", "llm_call", "decision")):
        own = ledger.entry_hash(prev, seq, "t", kind, {"é": 1.0})
        lines.append(json.dumps({"seq": seq, "ts": "t", "type": kind, "payload": {"é": 1.0}, "prev_hash": prev, "hash": own}))
        prev = own
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "chain_id string, line_no int, line string")
    pack = ledger.evidence(df, "own", by_type={"llm_call": ["l"]})
    header = json.loads(pack.filter("position = -1").first().line)["_meta"]
    assert header["entries"] == 3 and header["head_hash"] == prev and header["controls_covered"] == ["l"] and header["summary"]["llm_calls"] == 1
    ledger.export(pack, str(tmp_path / "out"))
    text = [x for f in sorted((tmp_path / "out/chain_id=c").glob("*.txt")) for x in f.read_text().splitlines()]
    again = spark.createDataFrame([("c", i, x) for i, x in enumerate(text)], "chain_id string, line_no int, line string")
    assert tuple(ledger.verify(again).first())[1:4] == (True, "ok", 3)


def test_drift_in_what_answers_say(spark):
    answer = lambda text: json.dumps({"output_text": text})
    rows = [("same", answer("the queue is empty now"), answer("The queue is empty, now!")), ("other", answer("the queue is empty now"), answer("no idea")), ("gone", answer("words"), None)]
    recorded = spark.createDataFrame([(h, a, 1) for h, a, _ in rows], "request_hash string, response string, at int")
    live = spark.createDataFrame([(h, b, 2) for h, _, b in rows], "request_hash string, response string, at int")
    got = {r.request_hash: r.score for r in replay.semantic_drift(recorded, live).collect()}
    assert set(got) == {"other", "gone"} and got["gone"] == 0
    df = spark.createDataFrame([("a b c", "a b c d"), ("x", "y")], "a string, e string")
    assert [r[0] for r in df.select(replay.semantic_match(F.col("a"), F.col("e"))).collect()] == [True, False]


@pytest.mark.parametrize(
    ("result", "usage", "model"),
    [
        ('{"generations": [[{"message": {"usage_metadata": {"input_tokens": 5, "output_tokens": "3", "input_token_details": {"cache_read": 2, "cache_creation": 1}, "output_token_details": {"reasoning": 2}}, "response_metadata": {"model": "g"}}}]]}', (5, 3, 2, 2, 1), "g"),
        ('{"generations": [[]], "llmOutput": {"tokenUsage": {"promptTokens": 4, "completionTokens": null, "promptTokensDetails": {"cachedTokens": 1}}, "modelName": "m"}}', (4, 0, 1, 0, 0), "m"),
        ('{"llmOutput": {"token_usage": {"input_tokens": "x", "output_tokens": 2, "completion_tokens_details": {"reasoning_tokens": 1}}}}', (0, 2, 0, 1, 0), ""),
        ('{"generations": []}', None, ""), (None, None, ""),
    ],
)
def test_results_of_runs(spark, result, usage, model):
    row = spark.createDataFrame([(result,)], "r string").select(ingest.run_usage(F.col("r")).alias("u"), ingest.run_model(F.col("r")).alias("m")).first()
    assert (tuple(row.u) if row.u else None) == usage and row.m == model


def test_visible_reasoning_and_time_to_first_token(spark):
    chunks = json.dumps([{"type": "content_block_delta", "delta": {"type": "thinking_delta", "thinking": "hm "}}, {"choices": [{"delta": {"reasoning_content": "so "}}]}, {"message": {"thinking": "yes"}}, {"message": {"content": "x"}}])
    df = spark.createDataFrame([(chunks,), ("{}",), (None,)], "r string").coalesce(1)
    assert [r[0] for r in df.select(ingest.thinking(F.col("r"))).collect()] == ["hm so yes", "", ""]
    times = spark.sql("SELECT array(timestamp'2026-01-01 00:00:02.5', timestamp'2026-01-01 00:00:01.25') AS c, timestamp'2026-01-01 00:00:01' AS s, CAST(array() AS array<timestamp>) AS e")
    assert tuple(times.select(ingest.first_token_ms(F.col("c"), F.col("s")), ingest.first_token_ms(F.col("e"), F.col("s"))).first()) == (250.0, None)


def test_payloads_are_read_as_text(spark):
    payloads = ["plain", '[{"role": "user", "content": "a"}, null, {"content": [{"text": "b"}, {"image": 1}, {"text": "c"}]}, 7]', '{"role": "user"}', '{"x": 1}', "", None]
    df = spark.createDataFrame([(p,) for p in payloads], "p string").coalesce(1)
    assert [r[0] for r in df.select(ingest.payload_text(F.col("p"))).collect()] == ["plain", "a\nbc\n7", "", '{"x": 1}', "", None]


def test_names_and_roots_of_runs(spark):
    events = [("a", None, "start", "chain", "planner", None), ("b", "a", "start", "llm", None, "in"), ("b", "a", "end", "llm", None, "{}"), ("c", "b", "start", "tool", "find", "q"), ("c", "b", "error", "tool", None, "boom"), ("d", "a", "start", "tool", "slow", "q"), ("e", "lost", "end", "tool", None, "r")]
    got = {r.run: r for r in ingest.run_calls(spark.createDataFrame(events, "run string, parent string, event string, kind string, name string, body string")).collect()}
    assert set(got) == {"b", "c", "e"}
    assert (got["b"].root, got["b"].agent, got["b"].model) == ("a", "planner", "") and (got["c"].name, got["c"].error, got["c"].input, got["c"].root) == ("find", "boom", "q", "a")
    assert (got["e"].name, got["e"].root, got["e"].agent) == ("tool", "e", None)
