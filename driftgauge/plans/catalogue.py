"""The named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name; ``sql`` is its oracle over the domain's common table expressions."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {domain.SQL.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().lstrip('+')}"
        return f

    return register


from . import queries_panel, queries_vintages, queries_evaluation, queries_models, queries_runs, queries_equations  # noqa: E402, F401, I001
