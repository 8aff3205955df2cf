"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthframe.sources.samples import view, with_views

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register f(tables) under a name; sql is a SELECT, or further ``, name AS (...)`` terms and a SELECT, over the views."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: view(spark, sf_dir, table))
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[name] = f"{with_views(*views)} {body}" if views else body
        return f

    return register
