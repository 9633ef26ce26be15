"""JSON texts as VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let


def strict_json(text: Column | str) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; null for all other texts.

    Spark's parser stops after the first value of a text. Inside a list of its own a text must be one whole
    element: what follows a value makes the list unreadable or longer.
    """
    text = F.col(text) if isinstance(text, str) else text
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(alone, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


#: A string of a JSON text with the colon that makes it a name. Strings are met from left to right, so the ends of each are its own.
_STRING = r'"(?:[^"\\]|\\.)*"\s*:?'


def _is_name(token: Column) -> Column:
    return token.endswith(":")


def _unquoted(token: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def quoted(text: Column) -> Column:
    """A string as JSON, characters as they are."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def string_values(text: Column) -> Column:
    """The string values (not the names) of a JSON text at any depth, in order; of a text that isn't JSON the text itself."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), lambda t: ~_is_name(t))
    return F.when(strict_json(text).isNotNull(), F.transform(tokens, _unquoted)).otherwise(F.array(text))


def map_string_values(text: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON text with its string values changed at any depth; names, order and spacing stay. A text that isn't JSON is changed as a whole."""

    def one(token: Column) -> Column:
        new = change(_unquoted(token))
        return F.when(_is_name(token) | (new == _unquoted(token)), token).otherwise(F.concat(quoted(new), F.regexp_extract(token, r"(\s*)$", 1)))

    gaps, tokens = F.split(text, _STRING, -1), F.regexp_extract_all(text, F.lit(_STRING), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, F.transform(tokens, one), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    return F.when(strict_json(text).isNotNull(), joined).otherwise(change(text))
