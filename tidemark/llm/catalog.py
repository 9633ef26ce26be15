"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["quantile_queries", "personal_queries", "lookalike_queries", "leak_queries", "mixing_queries", "quality_queries"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), attribute)
    return out


def llm_queries() -> dict:
    return _merged("QUERIES")


def llm_sql() -> dict:
    return _merged("SQL")
