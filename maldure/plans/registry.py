"""All core queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure import plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Every double rounded: sums of doubles depend on their order, which no engine fixes."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def _load_all() -> None:
    for module in iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            import_module(f"{plans.__name__}.{module.name}")


_load_all()
