"""How a module registers its queries under their names, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registrar(queries: dict[str, Query], sql: dict[str, str]) -> Callable[[str | None], Callable[[Query], Query]]:
    def query(text: str | None):
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return query
