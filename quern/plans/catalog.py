"""All queries of the library's own operators, by name, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import access, assets, documents, flows, governance, locations, pages, requests, search, tools, workflow

_FAMILIES = (governance, access, search, documents, workflow, locations, pages, tools, flows, assets, requests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLE.items()}
