"""Registered queries: input tables, Spark plans and SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = [
    "normalize", "profiles", "encoding", "tables", "headers", "numbers", "layout", "routing", "scoring", "reports", "flows",
]


def load():
    """Import every plan module once and return (queries, SQL texts)."""
    from sheetloom.plans import registry

    for name in MODULES:
        try:
            importlib.import_module(f"sheetloom.plans.{name}")
        except ModuleNotFoundError as err:
            if err.name != f"sheetloom.plans.{name}":
                raise
    return registry.QUERIES, registry.ORACLES
