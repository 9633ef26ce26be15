"""Nested JSON records as related flat tables.

``merged_schema`` reads every record once and reports each path below the records with the JSON
kinds found there (list positions are written ``[]``, so all elements of a list share a path).
``nodes`` explodes the records level by level, as deep as that schema goes: one row per object,
list and list element, carrying its own key, the key of the nearest enclosing object and its
position in the list. ``child_table`` projects the objects of one path into typed columns;
``members`` gives all nodes of all paths with their scalar values as one long table.

The walk works on VARIANT values, so that a string which happens to hold JSON stays a string and
a member that is sometimes a string and sometimes a list needs no common type.

Defined results: a null, blank or unreadable record has no nodes; an empty object is a node without
columns; records without any object give an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.json import strict_json
from tidemark.storage import broadcast_if_small, written

#: More distinct paths with objects than this mean that data stands in member names; they get no tables of their own then.
MAX_PATHS = 100_000

#: Columns of a child table; members beyond them stand in a map.
MAX_COLUMNS = 1000

NODE_FIELDS = "path string, template string, owner string, ordinal int, kind string, value variant"


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "double"
    return "null" if value is None else "string"


def _paths(text: str, root: str, counts: Counter) -> None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return
    open_nodes = [(root, value)]
    while open_nodes:
        path, value = open_nodes.pop()
        counts[path, _kind(value)] += 1
        if isinstance(value, dict):
            open_nodes.extend((f"{path}.{name}", member) for name, member in value.items())
        elif isinstance(value, list):
            open_nodes.extend((f"{path}[]", element) for element in value)


def merged_schema(records: DataFrame, texts: dict[str, str]) -> DataFrame:
    """(tbl, path, kind, n): the kinds found at each path of the JSON columns of ``records``.

    ``texts`` maps a root path (``$`` or ``$.request``) to the column that holds its JSON. Each
    partition counts its own paths first, so only a few rows per partition are shuffled.
    """
    roots = dict(texts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for root, column in roots.items():
                for tbl, text in zip(batch["tbl"], batch[column], strict=True):
                    if isinstance(text, str):
                        _paths(text, root, seen.setdefault(tbl, Counter()))
        rows = [(tbl, path, kind, n) for tbl, c in seen.items() for (path, kind), n in c.items()]
        yield pd.DataFrame(rows, columns=["tbl", "path", "kind", "n"])

    found = records.select("tbl", *dict.fromkeys(roots.values())).mapInPandas(
        count, "tbl string, path string, kind string, n long"
    )
    return found.groupBy("tbl", "path", "kind").agg(F.sum("n").alias("n"))


def depth(schema: DataFrame) -> int:
    """Steps from a record to its deepest object, or to a scalar in a list."""
    steps = F.size(F.regexp_extract_all("path", F.lit(r"\[\]|\.[^.\[]*"), F.lit(0)))
    nested = schema.filter(F.col("kind").isin("object", "array") | F.col("path").endswith("[]"))
    return nested.agg(F.max(steps)).first()[0] or 0


def _node(path: str, template: str, owner: str, ordinal: str, value: str) -> str:
    kind = f"CASE substr(schema_of_variant({value}), 1, 6) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY<' THEN 'array' ELSE 'scalar' END"
    return (
        f"named_struct('path', {path}, 'template', {template}, 'owner', {owner}, 'ordinal', {ordinal}, "
        f"'kind', {kind}, 'value', {value})"
    )


def _children(level: str) -> Column:
    """One level down: containers among the members of objects, and all elements of lists."""
    member = _node("concat(p.path, '.', e.key)", "concat(p.template, '.', e.key)", "p.path", "CAST(NULL AS INT)", "e.value")
    element = _node("concat(p.path, '[', i, ']')", "concat(p.template, '[]')", "p.owner", "i", "x")
    return F.expr(
        f"""flatten(transform({level}, p -> CASE p.kind
              WHEN 'object' THEN filter(transform(
                  map_entries(try_variant_get(p.value, '$', 'map<string,variant>')), e -> {member}), c -> c.kind != 'scalar')
              WHEN 'array' THEN transform(try_variant_get(p.value, '$', 'array<variant>'), (x, i) -> {element})
              ELSE CAST(array() AS array<struct<{NODE_FIELDS.replace(" string", ":string").replace(" int", ":int").replace(" variant", ":variant")}>>) END))"""
    )


def node_key(tbl: str, record_id: str, path: str) -> Column:
    """The surrogate key of a node: 128 bits of its record and path, the same in every run."""
    return F.md5(F.concat_ws("\u001f", F.col(tbl), F.col(record_id), F.col(path)))


def nodes(records: DataFrame, texts: dict[str, str], levels: int, roots: bool = False) -> DataFrame:
    """One row per object, list and list element below each record of (tbl, record_id, JSON columns as text or VARIANT).

    Columns: tbl, record_id, node_key, parent_key, path, template, owner (path of the nearest
    enclosing object), ordinal (position in a list, else null), kind and value. ``$`` stands for
    the record itself and is no row when it is a JSON text of its own. With ``roots`` every readable JSON
    text is a row, also ``$`` and texts that are a scalar. A narrow plan: no shuffle.
    """
    df = records
    parsed = lambda c: F.col(c) if dict(records.dtypes)[c] == "variant" else strict_json(c)
    if list(texts) == ["$"]:
        root = F.expr(f"array({_node(repr('$'), repr('$'), repr('$'), 'CAST(NULL AS INT)', 'v')})")
        df = df.withColumn("v", parsed(texts["$"])).withColumn("l0", root)
        first = 0 if roots else 1
    else:
        parts = []
        for i, (path, column) in enumerate(texts.items()):
            df = df.withColumn(f"v{i}", parsed(column))
            parts.append(_node(repr(path), repr(path), repr("$"), "CAST(NULL AS INT)", f"v{i}"))
        df = df.withColumn("l0", F.expr(f"filter(array({', '.join(parts)}), c -> {'true' if roots else "c.kind != 'scalar'"})"))
        first, levels = 0, max(0, levels - 1)
    df = df.select("tbl", "record_id", "l0")
    for k in range(levels):
        df = df.withColumn(f"l{k + 1}", _children(f"l{k}"))
    all_levels = [f"l{k}" for k in range(first, levels + 1)]
    if not all_levels:
        all_levels = ["filter(l0, c -> false)"]
    df = df.select("tbl", "record_id", F.explode(F.expr(f"concat({', '.join(all_levels)})")).alias("node"))
    df = df.select("tbl", "record_id", "node.*").filter("value IS NOT NULL" if roots else "true")
    return df.select(
        "tbl",
        "record_id",
        node_key("tbl", "record_id", "path").alias("node_key"),
        node_key("tbl", "record_id", "owner").alias("parent_key"),
        "path",
        "template",
        "owner",
        "ordinal",
        "kind",
        "value",
    )


#: A path as the template of an object and the name of one of its members.
_MEMBER = r"^(.*)\.([^.\[\]]+)$"
_TYPES = {"integer": "bigint", "double": "double", "boolean": "boolean", "string": "string"}


def columns_of(schema: DataFrame, tbl: str, template: str, limit: int = MAX_COLUMNS) -> list[tuple[str, str]]:
    """(member, Spark type) of the scalar members of the objects at ``template``, by the merged schema; the ``limit`` most frequent of them, by name.

    The kinds of a member are gathered before anything is cut, so the type is that of all its values. ``child_tables`` has the members beyond the limit in a map.
    """
    return _columns(schema.filter(F.col("tbl") == tbl), limit).get((tbl, template), [])


def _columns(schema: DataFrame, limit: int) -> dict[tuple[str, str], list[tuple[str, str]]]:
    """(tbl, template) -> the ``limit`` most frequent scalar members and their types, for all paths in one pass over the schema."""
    scalars = schema.filter(F.col("kind").isin([*_TYPES, "null"])).select("tbl", F.regexp_extract("path", _MEMBER, 1).alias("template"), F.regexp_extract("path", _MEMBER, 2).alias("name"), "kind", "n")
    kinds = scalars.filter("name <> ''").groupBy("tbl", "template", "name").agg(F.collect_set("kind").alias("kinds"), F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("tbl", "template").orderBy(F.col("n").desc(), "name"))
    out: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for row in kinds.withColumn("rank", rank).filter(F.col("rank") <= limit).collect():
        found = set(row["kinds"]) - {"null"}
        kind = found.pop() if len(found) == 1 else "double" if found == {"integer", "double"} else "string"
        out.setdefault((row["tbl"], row["template"]), []).append((row["name"], _TYPES[kind]))
    return {k: sorted(v) for k, v in out.items()}


def _scalar(value: str, path: str, kind: str) -> Column:
    """A scalar member; a container there has a table of its own and no value here."""
    found = F.try_variant_get(value, path, kind)
    if kind != "string":
        return found
    return F.when(F.substr(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit(1), F.lit(6)).isin("OBJECT", "ARRAY<"), F.lit(None)).otherwise(found)


def child_table(all_nodes: DataFrame, tbl: str, template: str, columns: list[tuple[str, str]], others: bool = False) -> DataFrame:
    """The flat table of one path: keys, position and the given scalar members of each object there.

    A member that clashes with a key column (record_id, node_key, parent_key, ordinal) gets the
    suffix ``_``. A value that doesn't fit its column's type is null, as is an absent member. With ``others`` the scalar members without a
    column of their own stand in ``others`` MAP<STRING, STRING>. A record itself has a null parent_key.
    """
    keys = ["record_id", "node_key", "parent_key", "ordinal"]
    rows = all_nodes.filter((F.col("tbl") == tbl) & (F.col("template") == template) & (F.col("kind") == "object"))
    rows = rows.withColumn("parent_key", F.when(F.col("path") != F.col("owner"), F.col("parent_key")))
    taken = {k.lower() for k in keys}
    picked = []
    for name, kind in columns:
        alias = name
        while alias.lower() in taken:
            alias += "_"
        taken.add(alias.lower())
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        picked.append(_scalar("value", path, kind).alias(alias))
    if others:
        scalars = F.map_filter(F.try_variant_get("value", "$", "map<string,variant>"), lambda k, v: ~F.substr(F.schema_of_variant(v), F.lit(1), F.lit(6)).isin("OBJECT", "ARRAY<") & ~k.isin([n for n, _ in columns] or [""]))
        name = "others"
        while name.lower() in taken:
            name += "_"
        picked.append(F.transform_values(scalars, lambda k, v: F.try_variant_get(v, "$", "string")).alias(name))
    return rows.select(*keys, *picked)


def child_tables(all_nodes: DataFrame, schema: DataFrame, limit: int = MAX_COLUMNS) -> dict[tuple[str, str], DataFrame]:
    """(tbl, template) -> the flat table of every path that has objects, with columns of the merged schema.

    The nodes are written once, a folder for each path, so the records are parsed and exploded in one pass and a table reads its own folder only. A
    path with more than ``limit`` members has the rest in ``others``. Paths are a bounded list; data in member names (more than MAX_PATHS paths) is refused
    with a hint to ``members``, which holds any number of them.
    """
    schema = written(schema, "schema")
    paths = schema.filter("kind = 'object'").select("tbl", "path").distinct().orderBy("tbl", "path").limit(MAX_PATHS + 1).collect()
    if len(paths) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths hold objects; use members")
    objects = all_nodes.filter("kind = 'object'").select("tbl", F.md5("template").alias("folder"), "template", "record_id", "node_key", "parent_key", "path", "owner", "ordinal", "kind", "value")
    stored = written(objects, "objects", ["tbl", "folder"])
    columns, out = _columns(schema, limit), {}
    more = {(r["tbl"], r["template"]) for r in _crowded(schema, limit).collect()}
    for tbl, path in paths:
        folder = stored.filter(F.col("folder") == hashlib.md5(path.encode()).hexdigest())
        out[tbl, path] = child_table(folder, tbl, path, columns.get((tbl, path), []), (tbl, path) in more)
    return out


def _crowded(schema: DataFrame, limit: int) -> DataFrame:
    """(tbl, template) of the paths with more than ``limit`` scalar members."""
    scalars = schema.filter(F.col("kind").isin([*_TYPES, "null"])).select("tbl", F.regexp_extract("path", _MEMBER, 1).alias("template"), "path").distinct()
    return scalars.groupBy("tbl", "template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def column_types(schema: DataFrame) -> DataFrame:
    """(tbl, column_path, type): the Spark type that ``columns_of`` gives to the scalars at each path of the merged schema."""
    scalars = schema.filter(F.col("kind").isin([*_TYPES, "null"])).groupBy("tbl", "path").agg(F.array_sort(F.collect_set(F.nullif("kind", F.lit("null")))).alias("kinds"))
    single = F.coalesce(*(F.when(F.col("kinds") == F.array(F.lit(k)), t) for k, t in _TYPES.items()))
    kind = F.when(F.col("kinds") == F.array(F.lit("double"), F.lit("integer")), "double").otherwise(F.coalesce(single, F.lit("string")))
    return scalars.select("tbl", F.col("path").alias("column_path"), kind.alias("type"))


def members(all_nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """Every node of every path with its scalar values, as one long table; ``all_nodes`` are those with ``roots``.

    (tbl, record_id, node_key, parent_key, path, template, ordinal, kind, member, type, value): an object has a row for
    each scalar member; a scalar that is no member of an object (in a list, or a whole text) has one without ``member``. An object without
    scalars and a list have one row without member and value, so no node is missing. ``path`` has the positions of all lists
    around a node. ``type`` is that of the column in the merged schema, ``value`` the scalar as a string (null for a
    JSON null); a record has no parent.
    """
    entries = "map_entries(try_variant_get(value, '$', 'map<string,variant>'))"
    scalars = f"filter({entries}, e -> substr(coalesce(schema_of_variant(e.value), ''), 1, 6) NOT IN ('OBJECT', 'ARRAY<'))"
    pair = lambda member, value: f"named_struct('member', {member}, 'value', try_variant_get({value}, '$', 'string'))"
    found = F.expr(
        f"""CASE kind WHEN 'object' THEN transform({scalars}, e -> {pair("e.key", "e.value")})
              WHEN 'scalar' THEN array({pair("CAST(NULL AS STRING)", "value")}) END"""
    )
    rows = all_nodes.withColumn("parent_key", F.when(F.col("path") != F.col("owner"), F.col("parent_key")))
    rows = rows.select("tbl", "record_id", "node_key", "parent_key", "path", "template", "ordinal", "kind", F.explode_outer(found).alias("m"))
    at = F.when(F.col("m.member").isNotNull(), F.concat("template", F.lit("."), "m.member")).when(F.col("kind") == "scalar", F.col("template"))
    types = column_types(schema)
    rows = rows.withColumn("column_path", at).join(broadcast_if_small(types), ["tbl", "column_path"], "left")
    return rows.select("tbl", "record_id", "node_key", "parent_key", "path", "template", "ordinal", "kind", "m.member", "type", "m.value")
