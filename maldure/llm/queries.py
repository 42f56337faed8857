"""The pN_ queries over the project's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[function.__name__] = function
    return function


def _load_all() -> None:
    from importlib import import_module
    from pkgutil import iter_modules

    from maldure import llm

    for module in iter_modules(llm.__path__):
        if module.name.startswith("q_"):
            import_module(f"{llm.__name__}.{module.name}")


_load_all()
