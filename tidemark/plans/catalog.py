"""All registered queries of the core and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["nested_records", "skewed_spend", "spend_queries", "detector_queries", "gate_queries", "text_queries", "record_queries", "stream_queries", "seam_queries"]


def _merged(attribute: str, package: str, modules: list[str]) -> dict:
    out: dict = {}
    for name in modules:
        found = getattr(importlib.import_module(f"{package}.{name}"), attribute)
        if clash := out.keys() & found.keys():
            raise ValueError(f"two queries are named {clash}")
        out |= found
    return out


def core_queries() -> dict:
    return _merged("QUERIES", __package__, MODULES)


def core_sql() -> dict:
    return _merged("SQL", __package__, MODULES)
