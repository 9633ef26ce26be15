"""Contexts put together under a token budget, with a receipt of what happened to each block.

A row holds the blocks of one context; they are tried pinned first, then by priority, then as they came, and one that doesn't fit is shrunk
by its strategy. Packing depends on all earlier blocks of the row and on nothing else, so rows are folded in Arrow batches without a
shuffle. Asking for another budget is the same expression with another number.

Defined results: null blocks give a null result; no blocks give none kept and nothing used; a pinned block that doesn't fit gives no
messages and the reason in ``overflow``; texts are cut between code points, and a cut text with its mark never exceeds what it may cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators import compress
from tidemark.operators.packing import PER_MESSAGE, PRIMING, ROLE_RANK

BLOCKS = "array<struct<role:string,content:string,priority:int,pin:boolean,evict:string,keep:string,images:int,turns:array<struct<role:string,content:string>>>>"
RESULT = "messages array<struct<role:string,content:string>>, used long, overflow string, decisions array<struct<block:int,role:string,action:string,before:long,after:long,note:string>>"
# What stands where a text was cut.
MARKS = {"head": "\n…[truncated]", "tail": "[truncated]…\n"}

#: A strategy takes a text, its budget and the end to keep, and gives the new text (None: drop the block), the action and a note.
Strategy = Callable[[str, int, str], tuple[str | None, str, str]]


def tail(text: str, target: int) -> str:
    """The longest end of at most ``target`` tokens."""
    return compress.cut(text[::-1], target)[::-1]


def cut_with_mark(text: str, target: int, keep: str = "head") -> str:
    """The text cut to ``target`` tokens with a mark at the cut; without the mark where there is no room for both."""
    if compress.estimate(text) <= target:
        return text
    room = target - compress.estimate(MARKS[keep])
    body = (compress.cut if keep == "head" else tail)(text, max(room, 0) or target)
    return body if room <= 0 else body + MARKS[keep] if keep == "head" else MARKS[keep] + body


def _truncate(text: str, target: int, keep: str) -> tuple[str | None, str, str]:
    return cut_with_mark(text, target, keep), "truncated", ""


def _drop(text: str, target: int, keep: str) -> tuple[str | None, str, str]:
    return None, "dropped", "block dropped whole (turns are dropped one by one)"


def _compress(text: str, target: int, keep: str) -> tuple[str | None, str, str]:
    small = compress.small_prose(text, target)
    return (small if compress.estimate(small) <= target else cut_with_mark(small, target, keep)), "compressed", ""


def summarizing(summary: Callable[[str, int], str]) -> Strategy:
    """A strategy from a function that summarizes a text to a number of tokens; a longer summary is cut, an error drops the block."""

    def run(text: str, target: int, keep: str) -> tuple[str | None, str, str]:
        try:
            return cut_with_mark(summary(text, target), target, keep), "summarized", ""
        except Exception as e:  # noqa: BLE001
            return None, "dropped", f"custom strategy raised: {e!r}"

    return run


STRATEGIES: dict[str, Strategy] = {"drop_oldest": _drop, "truncate": _truncate, "compress": _compress}


class _Overflow(Exception):
    pass


class _Pack:
    """The state of one context while its blocks are tried."""

    def __init__(self, room: int, image_tokens: int, strategies: Mapping[str, Strategy]) -> None:
        self.room, self.image_tokens, self.strategies = room, image_tokens, strategies
        self.used = 0
        self.kept: list[tuple[int, str, list[tuple[str, str]]]] = []
        self.decisions: list[tuple] = []

    def framing(self) -> int:
        return PER_MESSAGE + (0 if self.used else PRIMING)

    def add(self, index: int, role: str, messages: list[tuple[str, str]], tokens: list[int]) -> None:
        for n in tokens:
            self.used += self.framing() + n
        self.kept.append((index, role, messages))

    def block(self, index: int, b: dict) -> None:
        role, text = b["role"] or "", b["content"] or ""
        images = b["images"] or 0
        size = compress.estimate(text) + images * self.image_tokens
        left = self.room - self.used - self.framing()
        if size <= left:
            self.add(index, role, [(role, text)], [size])
            self.note(index, role, "kept", size, size, "")
        elif b["pin"]:
            raise _Overflow(f"pinned block {index} needs {size + self.framing()} tokens, {self.room - self.used} of {self.room} remain")
        elif images:
            self.note(index, role, "dropped", size, 0, "images: too large")
        elif left <= 0:
            self.note(index, role, "dropped", size, 0, "no room (framing)")
        else:
            name, keep = b["evict"] or "truncate", b["keep"] or "head"
            strategy = self.strategies.get(name)
            new, action, why = strategy(text, left, keep) if strategy else (None, "dropped", f"unknown strategy {name!r}")
            if new is not None:
                new = cut_with_mark(new, left, keep)
                self.add(index, role, [(role, new)], [compress.estimate(new)])
            self.note(index, role, action, size, compress.estimate(new) if new is not None else 0, why)

    def history(self, index: int, b: dict) -> None:
        """The newest turns that fit; the oldest are peeled off, and a newest turn that is too long alone keeps its end if the block may be truncated."""
        turns = [(t["role"] or "", t["content"] or "") for t in b["turns"]]
        sizes = [compress.estimate(t) for _, t in turns]
        left, first = self.room - self.used, len(turns)
        cost = 0
        while first and cost + PER_MESSAGE + (0 if self.used or cost else PRIMING) + sizes[first - 1] <= left:
            first -= 1
            cost += PER_MESSAGE + (0 if self.used or cost else PRIMING) + sizes[first]
        if first and b["pin"]:
            raise _Overflow(f"pinned history {index} needs {sum(sizes) + PER_MESSAGE * len(turns)} tokens, {left} of {self.room} remain")
        kept, tokens = turns[first:], sizes[first:]
        if first == len(turns) and first and b["evict"] == "truncate" and left - self.framing() > 0:
            role, text = turns[-1]
            text = cut_with_mark(text, left - self.framing(), "tail")
            kept, tokens = [(role, text)], [compress.estimate(text)]
        if kept:
            self.add(index, "history", kept, tokens)
        n, k = len(turns), len(kept)
        action = "kept" if k == n and not (first and k) else "truncated" if k else "dropped"
        why = "" if action == "kept" else f"history: kept {k} of {n} turns" if k else f"history: dropped all {n} turns (no room)"
        self.note(index, "history", action, sum(sizes), sum(tokens), why)

    def note(self, index: int, role: str, action: str, before: int, after: int, why: str) -> None:
        self.decisions.append((index, role, action, before, after, why))


def assemble(blocks: Iterable[dict], budget: int, reserve: int = 0, image_tokens: int = 0, strategies: Mapping[str, Strategy] = STRATEGIES) -> dict:
    """The messages, their tokens and the receipt of one context."""
    pack = _Pack(max(0, budget - reserve), image_tokens, strategies)
    try:
        for index, b in sorted(enumerate(blocks), key=lambda x: (not x[1]["pin"], -(x[1]["priority"] or 0), x[0])):
            (pack.history if b["turns"] is not None else pack.block)(index, b)
    except _Overflow as e:
        return {"messages": [], "used": 0, "overflow": str(e), "decisions": pack.decisions}
    ordered = sorted(pack.kept, key=lambda k: (ROLE_RANK.get(k[1], 1), k[0]))
    return {"messages": [m for _, _, ms in ordered for m in ms], "used": pack.used, "overflow": None, "decisions": pack.decisions}


def assembled(blocks: Column | str, budget: int, reserve: int = 0, image_tokens: int = 0, strategies: Mapping[str, Strategy] | None = None) -> Column:
    """STRUCT<messages, used, overflow, decisions> of a column of blocks (BLOCKS); further strategies come by name."""
    known = STRATEGIES | dict(strategies or {})

    @F.pandas_udf(RESULT)
    def run(rows: pd.Series) -> pd.DataFrame:
        found = [None if r is None else assemble(r, budget, reserve, image_tokens, known) for r in rows]
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        return pd.DataFrame({n: pd.Series([None if f is None else f[n] for f in found], dtype=object) for n in names})

    out = run(blocks)
    return F.when(F.col(blocks).isNotNull() if isinstance(blocks, str) else blocks.isNotNull(), out)
