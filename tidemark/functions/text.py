"""Text expressions whose meaning must not depend on the regular expression dialect.

``\\b``, ``\\w`` and ``\\d`` are ASCII here, ``\\s`` includes the non-breaking and the other Unicode blanks;
lines end at the ten boundaries of Python's ``splitlines``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters and anything else (Java's own is Unicode-aware).
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SPACE = r"[\t-\r    -     　﻿]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"


_BEFORE_WORD = re.compile(r"\\b(?=\\d|[A-Za-z]|\(\?:[A-Za-z]|(?:\(\?:)*\[[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\])")


def pattern(source: str) -> str:
    """A pattern written with ASCII ``\\b`` and wide ``\\s`` as a Java pattern.

    A boundary in front of a word character only has to look back, which fails early at most positions.
    """
    source = _BEFORE_WORD.sub(lambda _: r"(?<![A-Za-z0-9_])", source)
    return source.replace(r"\b", BOUNDARY).replace(r"\S", "[^" + SPACE[1:]).replace(r"\s", SPACE)


def matches(text: Column, source: str) -> Column:
    """All matches of a pattern; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern(source)), F.lit(0)), F.array().cast("array<string>"))


def replace(text: Column, source: str, by: str) -> Column:
    return F.regexp_replace(text, pattern(source), by)


def replace_valid(text: Column, source: str, valid, by: str) -> Column:
    """Replace only the matches for which ``valid`` (Column to Column) holds."""
    java = pattern(source)

    def pieces(found: Column) -> Column:
        both = F.zip_with(F.split(text, java, -1), found, lambda g, m: F.concat(g, F.when(m.isNull(), "").when(valid(m), by).otherwise(m)))
        return F.when(F.size(found) == 0, text).otherwise(F.array_join(both, ""))

    return let(F.regexp_extract_all(text, F.lit(java), F.lit(0)), pieces)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def lines(text: Column) -> Column:
    """The lines of a text, without one trailing empty line."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return let(F.split(text, LINE_END, -1), cut)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


# Model name beginnings of the first family, and what the others contain.
_OPENAI = r"^(?:gpt|chatgpt|text-|davinci|o\d)"


def family(model: Column) -> Column:
    """The tokenizer family of a model id; a fine-tune wrapper ``ft:<base>:...`` is unwrapped."""
    base = F.when(F.lower(model).startswith("ft:") & (F.split_part(model, F.lit(":"), F.lit(2)) != ""), F.split_part(model, F.lit(":"), F.lit(2))).otherwise(model)
    m = F.lower(base)
    return F.when(m.rlike(_OPENAI), "openai").when(m.contains("claude"), "anthropic").when(m.contains("gemini"), "google").otherwise("default")


def token_estimate(text: Column, fam: Column | str = "default") -> Column:
    """Tokens by the offline heuristic: a quarter of the characters, or half of characters / 3.5 plus 1.2 per piece."""
    fam = F.lit(fam) if isinstance(fam, str) else fam
    size = F.length(text)
    pieces = F.regexp_count(text, F.lit(pattern(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")))
    estimate = F.greatest(F.lit(1), F.ceil((size / F.lit(3.5) + pieces * F.lit(1.2)) / 2))
    return F.when(size == 0, F.lit(0)).when(fam == "openai", F.ceil(size / F.lit(4.0))).otherwise(estimate).cast("long")
