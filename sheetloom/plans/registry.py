"""Registered queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sheetloom.plans.ctes import SHARED
from sheetloom.plans.inputs import Inputs, with_ctes

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, fn: Callable[[Inputs], DataFrame], needs: str = "", sql: str | None = None) -> None:
    """Register a query; ``needs`` names the input tables and shared CTEs the SQL text reads."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = with_ctes(needs.split(), sql, SHARED)
