"""Hash-chained ledgers: canonical bytes, chain hashes, verification, summaries and export.

Lines are checked in parallel: each entry's hash is recomputed from its own fields, and its link is an equi-join with the
entry one position before it in file order, so a ledger of any length is spread over all tasks. The first
failure of a ledger is an aggregate over positions. Defined results: blank lines are skipped, an unreadable line is a failure at its
position, a ledger without entries is intact with 0 entries, a null chain id is a chain.
"""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json import quoted, strict_json
from tidemark.operators import ordered

GENESIS = "0" * 64
FIELDS = ("seq", "ts", "type", "payload", "prev_hash", "hash")


def canonical_text(value: object) -> str:
    """Sorted keys (by code point), compact, characters as they are, integers and floats kept apart."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def entry_hash(prev_hash: str, seq: object, ts: object, kind: object, payload: object) -> str:
    """SHA-256 of the previous hash's text and the canonical body of an entry."""
    return _sha(prev_hash + canonical_text({"seq": seq, "ts": ts, "type": kind, "payload": payload}))


def signature(key: str, text: str) -> str:
    return hmac.new(key.encode(), text.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()


def header_signature(key: str, meta: dict) -> str:
    """HMAC over the four fields that tell a complete export."""
    return signature(key, canonical_text({k: meta.get(k) for k in ("system", "risk_tier", "head_hash", "entries")}))


def canonical(text: Column | str) -> Column:
    """A JSON text in canonical form; null for null and unreadable texts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: object) -> str | None:
            try:
                return canonical_text(json.loads(t))
            except (TypeError, ValueError, RecursionError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)


def canonical_body(seq: Column, ts: Column, kind: Column, payload: Column) -> Column:
    """The canonical body of an entry given as columns, the payload as JSON text; null for an unreadable payload."""
    return F.concat(
        F.lit('{"payload":'), canonical(payload), F.lit(',"seq":'), seq.cast("string"), F.lit(',"ts":'), quoted(ts), F.lit(',"type":'), quoted(kind), F.lit("}")
    )


def chain_hash(prev_hash: Column, seq: Column, ts: Column, kind: Column, payload: Column) -> Column:
    """The hash of an entry given as columns, the payload as JSON text."""
    return F.sha2(F.concat(prev_hash, canonical_body(seq, ts, kind, payload)), 256)


def checked(lines: DataFrame, key: str | None = None) -> DataFrame:
    """chain_id, line_no, state (entry, meta, corrupt), fault, seq, prev_hash, hash, head and entries of each line that isn't blank."""
    schema = "state string, fault string, seq string, prev_hash string, hash string, head string, entries long"

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_check(t, key) for t in texts], columns=[c.split()[0] for c in schema.split(", ")]).astype({"entries": "Int64"})

    rows = lines.filter(F.col("line").isNotNull() & F.col("line").rlike(r"\S")).select("chain_id", "line_no", run("line").alias("c"))
    return rows.select("chain_id", "line_no", "c.*")


def _check(text: str, key: str | None) -> tuple:
    try:
        row = json.loads(text)
    except (ValueError, RecursionError):
        return "corrupt", "unreadable line", None, None, None, None, None
    if not isinstance(row, dict):
        return "corrupt", "line is not an object", None, None, None, None, None
    if "_meta" in row:
        meta = row["_meta"] if isinstance(row["_meta"], dict) else {}
        fault = None
        if key is not None:
            given = meta.get("sig")
            fault = None if isinstance(given, str) and hmac.compare_digest(given, header_signature(key, meta)) else "header signature mismatch" if given else "header carries no signature"
        count = meta.get("entries")
        return "meta", fault, None, None, None, meta.get("head_hash"), count if isinstance(count, int) else None
    for name in FIELDS:
        if name not in row:
            return "corrupt", f"missing '{name}'", None, None, None, None, None
    prev, own = row["prev_hash"], row["hash"]
    fault = None
    if not isinstance(prev, str) or own != entry_hash(prev, row["seq"], row["ts"], row["type"], row["payload"]):
        fault = "hash mismatch"
    elif key is not None and not hmac.compare_digest(str(row.get("sig") or ""), signature(key, own)):
        fault = "bad signature"
    return "entry", fault, str(row["seq"]), prev if isinstance(prev, str) else None, own if isinstance(own, str) else None, None, None


def linked(entries: DataFrame) -> DataFrame:
    """``entries`` (chain_id, line_no, prev_hash, hash, ...) with ``position`` and ``link``: does prev_hash name the entry before?"""
    rows = ordered.positions(entries, "chain_id", [F.col("line_no")], "ledger")
    before = rows.select(F.col("chain_id").alias("c"), (F.col("position") + 1).alias("p"), F.col("hash").alias("want"))
    rows = rows.join(before, rows.chain_id.eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")), "left").drop("c", "p")
    want = F.when(F.col("position") == 0, F.lit(GENESIS)).otherwise(F.col("want"))
    return rows.withColumn("link", F.col("prev_hash").eqNullSafe(want)).drop("want")


def verify(lines: DataFrame, key: str | None = None) -> DataFrame:
    """(chain_id, ok, detail, entries, head): the first failure of each ledger in file order, else its completeness."""
    rows = checked(lines, key)
    seq = F.coalesce("seq", F.lit("null"))
    entries = linked(rows.filter("state = 'entry'"))
    entries = entries.withColumn(
        "failure",
        F.when(~F.col("link"), F.concat(F.lit("broken link at seq "), seq, F.lit(": prev_hash mismatch"))).when(
            F.col("fault").isNotNull(), F.concat("fault", F.lit(" at seq "), seq)
        ),
    ).drop("position", "link")
    others = rows.filter("state <> 'entry'").withColumn("failure", F.when(F.col("state") == "corrupt", F.concat(F.lit("corrupt log: "), "fault")))
    of_meta = F.when(F.col("state") == "meta", F.col("line_no"))
    found = entries.unionByName(others).groupBy("chain_id")
    out = found.agg(
        F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("line_no"))).alias("failure"),
        F.count_if(F.col("state") == "entry").alias("n"),
        F.coalesce(F.max_by("hash", F.when(F.col("state") == "entry", F.col("line_no"))), F.lit(GENESIS)).alias("last"),
        F.max_by(F.struct("head", "entries", "fault"), of_meta).alias("m"),
    )
    detail = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("m.fault").isNotNull(), F.col("m.fault"))
        .when(F.col("m.head").isNotNull() & (F.col("m.head") != F.col("last")), "incomplete log: head differs")
        .when(F.col("m.entries").isNotNull() & (F.col("m.entries") != F.col("n")), F.concat(F.lit("incomplete log: found "), "n", F.lit(" entries, expected "), "m.entries"))
    )
    return out.select("chain_id", detail.isNull().alias("ok"), F.coalesce(detail, F.lit("ok")).alias("detail"), F.col("n").alias("entries"), F.col("last").alias("head"))


def once(lines: DataFrame) -> DataFrame:
    """The readable lines of each ledger as first written: no blank, cut or repeated ones."""
    rows = lines.withColumn("v", strict_json("line")).filter("v IS NOT NULL").drop("v")
    first = rows.groupBy("chain_id", F.sha2(canonical("line"), 256).alias("k")).agg(F.min_by(F.struct("line_no", "line"), "line_no").alias("r"))
    return first.select("chain_id", "r.*")


def summary(lines: DataFrame) -> DataFrame:
    """Counts of entry types and of guard actions of each ledger."""
    kind, action = F.get_json_object("line", "$.type"), F.get_json_object("line", "$.payload.action")
    rows = lines.select("chain_id", kind.alias("type"), action.alias("action")).filter("type IS NOT NULL")
    return rows.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("entries"),
        *(F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("decision", "llm_call", "tool_call", "human_oversight")),
        *(F.count_if((F.col("type") == "guardrail_decision") & (F.col("action") == a)).alias(f"{a}_actions") for a in ("flag", "block", "redact")),
    )


def event_counts(lines: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """Counts of the entries of one type by members of their payloads (column -> path), over all ledgers; an absent member is a null key."""
    keys = [F.get_json_object("line", f"$.payload.{path}").alias(name) for name, path in fields.items()]
    return lines.filter(F.get_json_object("line", "$.type") == kind).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_decisions(lines: DataFrame) -> DataFrame:
    """(chain_id, line_no, type, decision_id, actor, decided): each entry that names a decision with the decision's own entry.

    ``decided`` is its line; of several entries of one decision the first counts, and both are null where the ledger has none. Decisions are few against their
    entries and are spread by (chain_id, decision_id).
    """
    get = lambda p: F.get_json_object("line", p)
    rows = lines.select("chain_id", "line_no", get("$.type").alias("type"), get("$.payload.decision_id").alias("decision_id"), get("$.payload.actor").alias("actor")).filter("decision_id IS NOT NULL")
    own = rows.filter("type = 'decision'").groupBy(F.col("chain_id").alias("c"), F.col("decision_id").alias("d")).agg(F.min_by("actor", "line_no").alias("actor"), F.min("line_no").alias("decided"))
    return rows.drop("actor").join(own, F.col("chain_id").eqNullSafe(F.col("c")) & (F.col("decision_id") == F.col("d")), "left").drop("c", "d")


def controls(lines: DataFrame) -> DataFrame:
    """The sorted controls that the entries of each ledger cover."""
    found = F.explode(F.from_json(F.get_json_object("line", "$.controls"), "array<string>"))
    rows = lines.select("chain_id", found.alias("control"))
    return rows.groupBy("chain_id").agg(F.array_sort(F.collect_set("control")).alias("controls"))


def mapped_controls(
    lines: DataFrame, by_type: dict[str, list[str]], by_key: dict[str, list[str]] | None = None, flag_type: str = "policy_flag", keys: str = "$.payload.data", groups: dict[str, str] | None = None
) -> DataFrame:
    """``lines`` with ``controls``: what a framework's tables say of each entry, in their order, each control once.

    ``by_type`` has the controls of an entry type. An entry of ``flag_type`` gets those of its categories (a string or a list at ``keys``) and of
    their ``groups`` from ``by_key`` too. The tables are a framework's own and few, so they are part of the plan: no row leaves its task. An
    unreadable line, a header or a type without controls has an empty list.
    """

    def table(rows: dict[str, list[str]]) -> Column:
        pairs = [F.lit(x) if i == 0 else F.array(*map(F.lit, x)).cast("array<string>") for k, v in rows.items() for i, x in enumerate((k, v))]
        return F.create_map(*pairs).cast("map<string,array<string>>") if pairs else F.create_map().cast("map<string,array<string>>")

    none = F.array().cast("array<string>")
    kind = F.get_json_object("line", "$.type")
    found = F.coalesce(F.try_element_at(table(by_type), kind), none)
    if by_key:
        given = F.get_json_object("line", keys)
        names = F.coalesce(F.from_json(given, "array<string>"), F.when(given.isNotNull(), F.array(given)), none)
        group = F.create_map(*(F.lit(x) for pair in (groups or {"": ""}).items() for x in pair))
        every = F.flatten(F.transform(names, lambda n: F.array(n, F.coalesce(F.try_element_at(group, n), F.lit("")))))
        extra = F.flatten(F.transform(every, lambda n: F.coalesce(F.try_element_at(table(by_key), n), none)))
        found = F.when(kind == flag_type, F.array_distinct(F.concat(found, extra))).otherwise(found)
    return lines.withColumn("controls", F.coalesce(found, none))


def evidence(lines: DataFrame, framework: str, **tables: object) -> DataFrame:
    """(chain_id, position, line): each ledger as an evidence pack, a header with what it holds and covers and then its entries with their controls.

    The header has the counts of ``summary``, the sorted controls, the number of entries and the head that a reader can check. Entries keep their order;
    headers of an earlier export are left out.
    """
    rows = mapped_controls(lines, **tables).filter(strict_json("line").isNotNull() & F.get_json_object("line", "$._meta").isNull())  # type: ignore[arg-type]

    @F.pandas_udf("string")
    def with_controls(texts: pd.Series, controls: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(json.loads(t) | {"controls": list(c)}, ensure_ascii=False) for t, c in zip(texts, controls, strict=True)], dtype=object)

    entries = rows.select("chain_id", F.col("line_no").cast("long").alias("position"), with_controls("line", "controls").alias("line"))
    covered = rows.select("chain_id", F.explode_outer("controls").alias("c")).groupBy("chain_id").agg(F.array_sort(F.collect_set("c")).alias("controls_covered"))
    heads = rows.groupBy("chain_id").agg(F.count(F.lit(1)).alias("entries"), F.max_by(F.get_json_object("line", "$.hash"), "line_no").alias("head_hash"))
    counts = summary(rows).select(F.col("chain_id").alias("__c"), F.struct(*(c for c in summary(rows).columns if c not in ("chain_id", "entries"))).alias("summary"))
    meta = heads.join(covered, "chain_id").join(counts, F.col("chain_id").eqNullSafe(F.col("__c")), "left")
    body = F.struct(F.lit(framework).alias("framework"), "controls_covered", "summary", "head_hash", "entries")
    return meta.select("chain_id", F.lit(-1).cast("long").alias("position"), F.to_json(F.struct(body.alias("_meta"))).alias("line")).unionByName(entries)


def export(lines: DataFrame, directory: str) -> None:
    """Write each ledger's lines (chain_id, position, line) in order, one folder per ledger."""
    ranked = lines.select("chain_id", "position", "line")
    ranked.repartitionByRange("chain_id", "position").sortWithinPartitions("chain_id", "position").select("chain_id", "line").write.partitionBy("chain_id").text(directory)


def step_index(entries: DataFrame, trace: str, order: list[str]) -> DataFrame:
    """``entries`` with ``step``: 1-based position within a trace; a trace of any length is spread over many tasks."""
    rows = ordered.positions(entries, trace, [F.col(c) for c in order], "steps")
    return rows.withColumn("step", (F.col("position") + 1).cast("int")).drop("position")
