"""How query modules collect their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by their function's name, with the SQL of the same result where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = oracle(sql)
            return f

        return add
