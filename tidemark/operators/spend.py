"""Spend facts: reports by tags, totals under a filter, counters, running budgets and retention.

Money stays DECIMAL; a currency is part of the key wherever there can be several. Defined results: a missing tag is a
null key; unpriced rows add 0 and are counted; an empty table gives an empty report; tags that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordered
from tidemark.storage import written

MONEY = "decimal(38,9)"
#: Rows of a key that tasks cut to before a shuffle (Spark's own bound for it).
GROUP_LIMIT = 1000
#: Rounds over running sums before the calls still undecided are folded one by one.
ROUNDS = 4


def tag(name: str) -> Column:
    """The value of a tag, null where it is missing."""
    return F.try_element_at("tags", F.lit(name))


def _measures() -> list[Column]:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [
        F.sum(F.coalesce("usd", F.lit(0).cast("decimal(18,9)"))).cast(MONEY).alias("usd"),
        F.sum(zero("input_tokens") + zero("output_tokens")).alias("tokens"),
        F.sum(zero("input_tokens")).alias("input_tokens"),
        F.sum(zero("output_tokens")).alias("output_tokens"),
        F.sum(zero("reasoning_tokens")).alias("reasoning_tokens"),
        F.sum(zero("calls")).alias("calls"),
        F.sum(F.when(F.col("unpriced"), F.col("calls")).otherwise(0)).alias("unpriced_calls"),
    ]


def report(spend: DataFrame, group_by: list[str]) -> DataFrame:
    """One row per combination of the tags; without tags one row, or none if there are no records."""
    keys = [tag(k).alias(k) for k in group_by]
    out = spend.groupBy(*keys).agg(*_measures())
    return out if group_by else out.filter(F.col("calls").isNotNull())


def under(spend: DataFrame, cap: str, tags: dict[str, str]) -> DataFrame:
    """(usd, cap, ok): the spend of the rows that carry all ``tags`` against a cap; only more than the cap fails."""
    for name, value in tags.items():
        spend = spend.filter(tag(name) == value)
    total = spend.agg(F.coalesce(F.sum("usd"), F.lit(0)).cast(MONEY).alias("usd"))
    limit = F.lit(cap).cast(MONEY)
    return total.select("usd", limit.alias("cap"), (F.col("usd") <= limit).alias("ok"))


def counters(spend: DataFrame, tag_name: str) -> DataFrame:
    """Metric counters by model and one tag: tokens, cost and reasoning tokens."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return spend.groupBy("model", tag(tag_name).alias(tag_name)).agg(
        F.sum(zero("input_tokens") + zero("output_tokens")).alias("tokens"),
        F.coalesce(F.sum("usd"), F.lit(0)).cast(MONEY).alias("cost"),
        F.sum(zero("reasoning_tokens")).alias("reasoning"),
    )


def once(spend: DataFrame) -> DataFrame:
    """Each ``spend_id`` once, as it was logged first; rows without an id stay."""
    keyed = spend.filter("spend_id IS NOT NULL")
    rest = [c for c in spend.columns if c not in ("spend_id", "logged_at")]
    first = keyed.groupBy("spend_id").agg(F.min_by(F.struct("logged_at", *rest), F.coalesce("logged_at", F.lit("9999-01-01").cast("timestamp"))).alias("r"))
    return first.select("spend_id", "r.*").select(*spend.columns).unionByName(spend.filter("spend_id IS NULL"))


def running_spend(spend: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """spend_id, key, ts, usd and the accrued usd, tokens and calls of the key up to and with this row (by ts, spend_id)."""
    rows = spend.select(
        "spend_id",
        key.alias(name),
        "ts",
        (F.coalesce("usd", F.lit(0).cast("decimal(18,9)")) * 1_000_000_000).cast("long").alias("nano"),
        (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
        F.coalesce("calls", F.lit(0)).cast("long").alias("calls"),
    )
    out = ordered.running(rows, name, [F.col("ts"), F.col("spend_id")], ["nano", "tokens", "calls"], "budget")
    nano = F.col("before_nano") + F.col("nano")
    return out.select(
        "spend_id",
        name,
        "ts",
        (nano.cast("decimal(28,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast(MONEY).alias("spent_usd"),
        (F.col("before_tokens") + F.col("tokens")).alias("spent_tokens"),
        (F.col("before_calls") + F.col("calls")).alias("spent_calls"),
    )


def first_breach(running: DataFrame, name: str, cap_usd: str) -> DataFrame:
    """The first row of each key that brings it over its cap (strictly more)."""
    over = running.filter(F.col("spent_usd") > F.lit(cap_usd).cast(MONEY))
    return over.groupBy(name).agg(F.min_by("spend_id", F.struct("ts", "spend_id")).alias("spend_id"), F.min("spent_usd").alias("spent_usd"))


def newest(spend: DataFrame, key: Column, keep: int, name: str = "key") -> DataFrame:
    """The last ``keep`` rows of each key by (ts, spend_id), as (spend_id, key).

    Up to GROUP_LIMIT rows every task keeps only its own last rows of a key before anything is shuffled; more are numbered in order.
    """
    rows = spend.select("spend_id", key.alias(name), "ts")
    order = [F.col("ts").desc(), F.col("spend_id").desc()]
    if keep <= GROUP_LIMIT:
        ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
        return ranked.filter(F.col("__rank") <= keep).select("spend_id", name)
    return ordered.positions(rows, name, order, "newest").filter(F.col("position") < keep).select("spend_id", name)


def enforced(spend: DataFrame, key: Column, cap_usd: str, name: str = "key") -> DataFrame:
    """(spend_id, key, allowed): calls in order (ts, spend_id), each blocked if it would bring the key over its cap.

    A blocked call costs nothing, so a verdict depends on all earlier ones. Rather than one task per key, rounds over
    running sums decide many calls at once: what comes before a key's first overflow is allowed, the overflowing call is
    blocked, and so is every later call that costs more than what is left, as the rest only shrinks. The keys still open go on; what
    is undecided after ROUNDS is folded in order, a key's room carried from row to row without holding the rows.
    """
    cap = int(Decimal(cap_usd).scaleb(9))
    nano = (F.coalesce("usd", F.lit(0).cast("decimal(18,9)")) * 1_000_000_000).cast("long")
    open_rows = spend.select("spend_id", key.alias(name), "ts", nano.alias("nano"), F.lit(cap).cast("long").alias("room"))
    parts: list[DataFrame] = [open_rows.filter("nano > room").select("spend_id", name, F.lit(False).alias("allowed"))]
    open_rows = open_rows.filter("nano <= room")
    for _ in range(ROUNDS):
        if open_rows.isEmpty():
            break
        rows = written(ordered.running(open_rows, name, [F.col("ts"), F.col("spend_id")], ["nano"], "cap"), "cap")
        over = rows.filter("before_nano + nano > room")
        first = over.groupBy(F.col(name).alias("__k")).agg(
            F.min_by(F.struct(F.col("ts").alias("ts0"), F.col("spend_id").alias("id0"), (F.col("room") - F.col("before_nano")).alias("left")), F.struct("ts", "spend_id")).alias("f")
        )
        rows = written(rows.join(first, F.col(name).eqNullSafe(F.col("__k")), "left").drop("__k"), "cap")
        at = F.struct(F.col("ts"), F.col("spend_id"))
        stop = F.struct(F.col("f.ts0").alias("ts"), F.col("f.id0").alias("spend_id"))
        free = F.col("f").isNull() | (at < stop)
        parts.append(rows.filter(free).select("spend_id", name, F.lit(True).alias("allowed")))
        late = rows.filter(~free)
        blocked = (at == stop) | (F.col("nano") > F.col("f.left"))
        parts.append(late.filter(blocked).select("spend_id", name, F.lit(False).alias("allowed")))
        open_rows = late.filter(~blocked).select("spend_id", name, "ts", "nano", F.col("f.left").alias("room"))
    else:
        parts.append(_folded(open_rows, name))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clamped(calls: DataFrame, cap_tokens: int, name: str = "key") -> DataFrame:
    """(spend_id, key, action, output) of calls (spend_id, key, ts, input, output) under a cap of tokens, in order (ts, spend_id).

    A call whose output doesn't fit is ``clamped`` to what is left after its input; one whose input alone leaves nothing is ``blocked`` and costs
    nothing; the others are ``allowed``. Null counts are 0. Each ceiling depends on all earlier ones, so a key is folded in order by one task,
    which holds one number and no rows.
    """
    schema = T.StructType([*calls.select("spend_id", name).schema.fields, T.StructField("action", T.StringType()), T.StructField("output", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: object = ()
        room = 0
        for batch in batches:
            keys = batch[name].astype(object).where(batch[name].notna(), None)
            actions, outputs = [], []
            for key, asked, wanted in zip(keys, batch["input"].fillna(0).astype("int64").tolist(), batch["output"].fillna(0).astype("int64").tolist(), strict=True):
                if key != last:
                    last, room = key, cap_tokens
                ceiling = room - asked
                given = min(wanted, ceiling)
                actions.append("blocked" if ceiling <= 0 else "clamped" if given < wanted else "allowed")
                outputs.append(given if ceiling > 0 else 0)
                room -= asked + given if ceiling > 0 else 0
            yield batch[["spend_id", name]].assign(action=actions, output=outputs)

    return calls.select("spend_id", name, "ts", "input", "output").repartition(name).sortWithinPartitions(name, "ts", "spend_id").mapInPandas(fold, schema)


def _folded(rows: DataFrame, name: str) -> DataFrame:
    """(spend_id, key, allowed) of calls whose key has ``room``, taken one after the other."""
    schema = T.StructType([*rows.select("spend_id", name).schema.fields, T.StructField("allowed", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: object = ()
        room = 0
        for batch in batches:
            keys = batch[name].astype(object).where(batch[name].notna(), None)
            allowed = []
            for key, nano, start in zip(keys, batch["nano"].tolist(), batch["room"].tolist(), strict=True):
                if key != last:
                    last, room = key, start
                allowed.append(nano <= room)
                room -= nano if allowed[-1] else 0
            yield batch[["spend_id", name]].assign(allowed=allowed)

    return rows.repartition(name).sortWithinPartitions(name, "ts", "spend_id").mapInPandas(fold, schema)
