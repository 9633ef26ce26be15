"""Nested records as flat tables, against a plain walk over the parsed JSON."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import nested
from tidemark.sources.recordings import cassette_records, chain_records


def walk(value, path="$", owner="$"):
    """(owner, path) of every object below ``value``."""
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}"
            if isinstance(v, dict):
                yield path, at
            yield from walk(v, at, path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            at = f"{path}[{i}]"
            if isinstance(v, dict):
                yield owner, at
            yield from walk(v, at, owner)


def objects(spark, docs):
    rows = spark.createDataFrame([("t", str(i), d) for i, d in enumerate(docs)], "tbl string, record_id string, doc string")
    levels = nested.depth(nested.merged_schema(rows, {"$": "doc"}))
    found = nested.nodes(rows, {"$": "doc"}, levels).filter("kind = 'object'").select("record_id", "owner", "path").collect()
    return sorted(map(tuple, found))


def test_mixed_members_lists_in_lists_and_json_in_strings(spark):
    docs = [
        '{"a": {"b": [1, {"c": "{\\"no\\": 1}"}, [{"d": {}}, [{"e": 2}]]]}, "f": {}, "g": null}',
        '{"a": "text", "f": [{}, {}]}',
        '{"a": [[], [[{}]]]}',
        "[1, 2]",
        "7",
    ]
    expected = sorted((str(i), o, p) for i, d in enumerate(docs) for o, p in walk(json.loads(d)))
    assert objects(spark, docs) == expected


def test_null_blank_cut_and_followed_texts_have_no_nodes(spark):
    assert objects(spark, [None, "", "  ", '{"a": {"b"', '{"a": {}} {"b": {}}', '{"a": {}} rest', '{"x": 1}']) == []


def test_an_empty_table_gives_an_empty_table(spark):
    assert objects(spark, []) == []


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab{[", max_size=3),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "A", "c d"]), x, max_size=3),
    max_leaves=12,
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(json_values, min_size=1, max_size=30))
def test_any_json(spark, values):
    docs = [json.dumps(v) for v in values]
    assert objects(spark, docs) == sorted((str(i), o, p) for i, d in enumerate(docs) for o, p in walk(json.loads(d)))


def test_child_table_has_typed_columns_keys_and_no_clashes(spark):
    rows = spark.createDataFrame([("t", "r", '{"m": [{"ordinal": 1, "x": 2.5, "y": null}, {"x": 3, "y": "s", "z": true}]}')], "tbl string, record_id string, doc string")
    schema = nested.merged_schema(rows, {"$": "doc"})
    columns = nested.columns_of(schema, "t", "$.m[]")
    assert columns == [("ordinal", "bigint"), ("x", "double"), ("y", "string"), ("z", "boolean")]
    nodes = nested.nodes(rows, {"$": "doc"}, nested.depth(schema))
    table = nested.child_table(nodes, "t", "$.m[]", columns)
    assert table.columns == ["record_id", "node_key", "parent_key", "ordinal", "ordinal_", "x", "y", "z"]
    assert [tuple(r)[3:] for r in table.orderBy("ordinal").collect()] == [(0, 1, 2.5, None, None), (1, None, 3.0, "s", True)]
    assert table.select("parent_key").distinct().count() == 1


def test_types_are_those_of_all_values_however_many_members(spark):
    schema = spark.createDataFrame([("t", f"$.m.k{i}", kind, 1) for i in range(3000) for kind in ("integer", "string")], "tbl string, path string, kind string, n long")
    columns = nested.columns_of(schema, "t", "$.m", 2500)
    assert len(columns) == 2500 and {kind for _, kind in columns} == {"string"}


def test_child_tables_hold_every_member_of_every_path(spark):
    docs = [{"a": 1, "b": "x", "m": [{"p": 1.5, "q": {"z": True}}, {"p": "s", "r": [1]}]}, {"a": 2, "c": None, "m": []}, {"m": {"deep": {"k": 3}}}]
    rows = spark.createDataFrame([("t", f"r{i}", json.dumps(d)) for i, d in enumerate(docs)], "tbl string, record_id string, doc string")
    schema = nested.merged_schema(rows, {"$": "doc"})
    nodes = nested.nodes(rows, {"$": "doc"}, nested.depth(schema), roots=True)
    tables = nested.child_tables(nodes, schema)
    assert {t for _, t in tables} == {"$", "$.m[]", "$.m[].q", "$.m", "$.m.deep"}
    top = {r.record_id: (r.parent_key, r.a, r.b, r.c) for r in tables["t", "$"].collect()}
    assert top == {"r0": (None, 1, "x", None), "r1": (None, 2, None, None), "r2": (None, None, None, None)}
    parts = tables["t", "$.m[]"].orderBy("ordinal").collect()
    assert [(r.ordinal, r.p) for r in parts] == [(0, "1.5"), (1, "s")] and parts[0].parent_key == tables["t", "$"].filter("record_id = 'r0'").first().node_key
    narrow = nested.child_tables(nodes, schema, limit=1)["t", "$"]
    assert narrow.columns[4:] == ["a", "others"] and {r.record_id: r.others for r in narrow.collect()} == {"r0": {"b": "x"}, "r1": {"c": None}, "r2": {}}


def test_a_long_record_is_walked_whole(spark):
    doc = json.dumps({"m": [{"i": i, "t": "x" * 50} for i in range(20_000)]})
    assert len(objects(spark, [doc])) == 20_000


def test_chain_records_count_once(spark):
    good = '{"seq": 1, "payload": {"a": {}}}'
    rows = [("c", 0, '{"_meta": {"s": {}}}'), ("c", 1, good[:20]), ("c", 2, good), ("c", 3, good), ("c", 4, " "), ("c", 5, None), (None, 6, '{"payload": {}}')]
    df = spark.createDataFrame(rows, "chain_id string, line_no int, line string").withColumn("doc", F.lit(1)).withColumn("tbl", F.lit("x"))
    assert sorted(r.record_id for r in chain_records(df).collect()) == ["/line6", "c/1", "c/meta"]


def test_cassette_records_count_once(spark):
    kind = "cassette_id string, arrived_at timestamp_ntz, entries array<struct<seq int, request string, response string>>"
    import datetime as dt

    t0, t1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    rows = [("k", t1, [(0, "{}", "2")]), ("k", t0, [(0, "{}", "1"), (1, None, None)]), ("n", None, None), ("e", t0, [])]
    got = sorted((r.record_id, r.response) for r in cassette_records(spark.createDataFrame(rows, kind)).collect())
    assert got == [("k/0", "1"), ("k/1", None)]


@pytest.mark.parametrize("n", [1, 2])
def test_schema_merges_kinds(spark, n):
    docs = ['{"a": 1}', '{"a": "s"}', '{"a": [1, 2]}'] * n
    rows = spark.createDataFrame([("t", str(i), d) for i, d in enumerate(docs)], "tbl string, record_id string, doc string")
    got = {(r.path, r.kind): r.n for r in nested.merged_schema(rows, {"$": "doc"}).collect()}
    assert got == {("$", "object"): 3 * n, ("$.a", "integer"): n, ("$.a", "string"): n, ("$.a", "array"): n, ("$.a[]", "integer"): 2 * n}


def scalars(value, path="$", template="$", ordinal=None, member=None):
    """(path, template, ordinal, kind, member, value) of every node and scalar."""
    if isinstance(value, dict):
        plain = [(path, template, ordinal, "object", k, v) for k, v in value.items() if not isinstance(v, dict | list)]
        yield from plain or [(path, template, ordinal, "object", None, None)]
        for k, v in value.items():
            if isinstance(v, dict | list):
                yield from scalars(v, f"{path}.{k}", f"{template}.{k}")
    elif isinstance(value, list):
        yield path, template, ordinal, "array", None, None
        for i, v in enumerate(value):
            yield from scalars(v, f"{path}[{i}]", f"{template}[]", i)
    else:
        yield path, template, ordinal, "scalar", None, value


def test_members_hold_every_scalar_of_every_path(spark):
    docs = [
        '{"s": "x", "n": 1, "z": null, "m": [{"x": 1, "f": {"g": true, "h": []}}, {"x": 2.5, "f": {}}, "t", [7, [null, {"deep": "d"}]]], "e": {}}',
        '{"n": "two", "m": "text", "k.k": {"it\'s": 3}}',
        "[1, 2]",
        "7",
        "null",
    ]
    rows = spark.createDataFrame([("t", str(i), d) for i, d in enumerate([*docs, None, "{"])], "tbl string, record_id string, doc string")
    schema = nested.merged_schema(rows, {"$": "doc"})
    got = nested.members(nested.nodes(rows, {"$": "doc"}, nested.depth(schema), roots=True), schema).collect()
    text = lambda v: {True: "true", False: "false"}[v] if isinstance(v, bool) else None if v is None else str(v)
    expected = sorted(repr((str(i), *x[:-1], text(x[-1]))) for i, d in enumerate(docs) for x in scalars(json.loads(d)))
    assert sorted(repr((r.record_id, r.path, r.template, r.ordinal, r.kind, r.member, r.value)) for r in got) == expected
    types = {(r.template, r.member): r.type for r in got if r.kind != "array"}
    assert types["$.m[]", "x"] == "double" and types["$", "n"] == "string" and types["$.m[].f", "g"] == "boolean" and types["$.m[][]", None] == "bigint"
    keys = {r.node_key for r in got}
    assert all(r.parent_key in keys if r.path != "$" else r.parent_key is None for r in got)


def test_registered_members_cover_all_objects(spark):
    from pathlib import Path

    from tidemark.plans import nested_records as Q

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("the test tables aren't here")
    key = ["tbl", "record_id", "path"]
    objects = Q.p1_members(spark, data).filter("kind = 'object'").select(*key).distinct()
    assert Q.p1_found(spark, data).withColumnRenamed("child_path", "path").select(*key).exceptAll(objects).count() == 0
