"""Conversations and blocks packed into a token budget.

Messages stand in one row per conversation as ARRAY<STRUCT<role, content, tokens, ...>>, so packing is a fold inside the row:
no shuffle, and a conversation is bounded by its own size. Defined results: null and empty arrays keep nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as tx

#: Tokens charged once per context and per message.
PRIMING, PER_MESSAGE = 3, 4
# Ranks of roles in the default order.
ROLE_RANK = {"system": 0, "history": 1, "tool": 1, "assistant": 2, "user": 3}

#: Tokens of an image part, unless the caller says otherwise.
IMAGE_TOKENS = 0


def content_tokens(content: Column, fam: Column | str = "default", image_tokens: int = IMAGE_TOKENS) -> Column:
    """Tokens of a message's whole content, a VARIANT: a text, or a list of parts at two levels (parts of tool results).

    A part counts with its text; a part of another kind with its JSON, so nothing is left out; an image part costs
    ``image_tokens`` besides its text. A null content has no tokens.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    kind = lambda v: F.coalesce(F.substr(F.schema_of_variant(v), F.lit(1), F.lit(6)), F.lit("VOID"))
    inner = lambda p: get(p, "$.content", "variant")
    image = lambda p: F.coalesce(get(p, "$.type", "string").isin("image", "image_url"), F.lit(False))

    def pieces(part: Column) -> Column:
        below = inner(part)
        listed = F.when(kind(below) == "ARRAY<", get(below, "$", "array<variant>"))
        return F.coalesce(listed, F.when(kind(below) == "STRING", F.array(below)), F.array(part))

    def text(part: Column) -> Column:
        own = F.when(kind(get(part, "$.text", "variant")) == "STRING", get(part, "$.text", "string"))
        plain = F.when(kind(part).isin("OBJECT", "ARRAY<"), F.when(image(part), F.coalesce(own, F.lit(""))).otherwise(F.coalesce(own, F.to_json(part))))
        return F.coalesce(plain, get(part, "$", "string"), F.lit(""))

    def of_parts(parts: Column) -> Column:
        return tx.token_estimate(F.array_join(F.transform(parts, text), ""), fam) + F.size(F.filter(parts, image)) * F.lit(image_tokens)

    parts = F.when(kind(content) == "ARRAY<", F.flatten(F.transform(get(content, "$", "array<variant>"), pieces))).otherwise(F.array(content))
    return F.when(kind(content) == "VOID", F.lit(0)).otherwise(tx.let(parts, of_parts)).cast("long")


def kept_history(tokens: Column, budget: int, reserve: int = 0) -> Column:
    """How many of the newest turns fit: a suffix that ends at the first turn that doesn't."""
    room = max(0, budget - reserve)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, t: Column) -> Column:
        cost = F.when(acc.kept == 0, F.lit(PRIMING)).otherwise(F.lit(0)) + PER_MESSAGE + t
        fits = ~acc.full & (acc.used + cost <= room)
        return F.struct(
            F.when(fits, acc.used + cost).otherwise(acc.used).cast("long").alias("used"),
            F.when(fits, acc.kept + 1).otherwise(acc.kept).cast("int").alias("kept"),
            (~fits).alias("full"),
        )

    return F.coalesce(F.aggregate(F.reverse(tokens), start, step, lambda a: a.kept), F.lit(0))


def first_fit(tokens: Column, budget: int, reserve: int = 0) -> Column:
    """STRUCT<used, kept>: positions of the blocks that fit when tried in order; one that doesn't fit is skipped and costs nothing."""
    room = max(0, budget - reserve)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    items = F.transform(tokens, lambda t, i: F.struct(t.cast("long").alias("t"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        cost = F.when(F.size(acc.kept) == 0, F.lit(PRIMING)).otherwise(F.lit(0)) + PER_MESSAGE + x.t
        fits = acc.used + cost <= room
        return F.struct(
            F.when(fits, acc.used + cost).otherwise(acc.used).cast("long").alias("used"),
            F.when(fits, F.array_append(acc.kept, x.i)).otherwise(acc.kept).alias("kept"),
        )

    return F.aggregate(items, start, step)


def block_order(blocks: Column) -> Column:
    """Blocks (with pin, priority) in packing order: pinned first, then by priority, then as they came."""
    keyed = F.transform(blocks, lambda b, i: F.struct((~F.coalesce(b.pin, F.lit(False))).alias("a"), (-b.priority).alias("p"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda k: k.b)


def edge_loaded(items: Column) -> Column:
    """A descending list with the highest at both ends and the lowest in the middle."""
    left = F.filter(items, lambda x, i: i % 2 == 0)
    right = F.filter(items, lambda x, i: i % 2 == 1)
    return F.concat(left, F.reverse(right))


def message_order(messages: Column, mode: str = "default") -> Column:
    """Messages (with role, priority, pin) in the order default, attention or cache."""
    index = F.transform(messages, lambda m, i: F.struct(m.alias("m"), i.alias("i")))

    def ordered(items: Column, *keys) -> Column:
        rows = F.transform(items, lambda x: F.struct(*(k(x).alias(f"k{n}") for n, k in enumerate(keys)), x.i.alias("i"), x.m.alias("m")))
        return F.transform(F.array_sort(rows), lambda r: r.m)

    if mode == "cache":
        return ordered(index, lambda x: ~F.coalesce(x.m.pin, F.lit(False)), lambda x: -x.m.priority)
    if mode == "attention":
        part = lambda test: F.filter(index, test)
        first = ordered(part(lambda x: x.m.role == "system"), lambda x: -x.m.priority)
        last = ordered(part(lambda x: x.m.role == "user"), lambda x: x.m.priority)
        middle = ordered(part(lambda x: ~x.m.role.isin("system", "user")), lambda x: -x.m.priority)
        return F.concat(first, edge_loaded(middle), last)
    if mode != "default":
        raise ValueError(f"unknown order {mode!r}")
    rank = F.create_map(*(F.lit(v) for pair in ROLE_RANK.items() for v in pair))
    return ordered(index, lambda x: F.coalesce(F.try_element_at(rank, x.m.role), F.lit(1)))


def split_system(messages: Column) -> Column:
    """STRUCT<system, messages>: the system texts joined by a blank line, and the rest (as some providers want it)."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m.role == "system"), lambda m: m.content), "\n\n")
    return F.struct(system.alias("system"), F.filter(messages, lambda m: m.role != "system").alias("messages"))


def provider_roles(messages: Column, provider: str) -> Column:
    """Messages with the roles that a provider knows: model for assistant where it says so, user for all others."""
    assistant = {"gemini": "model"}.get(provider, "assistant")
    return F.transform(messages, lambda m: F.struct(F.when(m.role == "assistant", assistant).otherwise("user").alias("role"), m.content.alias("content")))
