"""All queries of the reference's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True) -> Callable:
    """Registers a function of :class:`Tables` under its name, with the SQL that must give the same."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = (PRELUDE + (", " if sql.lstrip().startswith("+") else "") + sql.lstrip().lstrip("+")) if prelude else sql
        return f

    return register


from . import graph_queries, operator_queries, search_queries, text_queries  # noqa: E402, F401
