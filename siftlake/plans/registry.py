"""All queries over the provided tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlake.session import shipped

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder of tables) under its name; sql gives the same rows in DuckDB."""

    def add(f):
        _QUERIES[f.__name__] = shipped(f)
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from siftlake.plans import catalog, dlq, flows, ingest, metrics, pieces, rows, scalars, search  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_rrf"](spark, sf_dir)
