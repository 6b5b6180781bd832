"""Named queries: a Spark plan each, and where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Registry:
    def __init__(self) -> None:
        self.found: dict[str, Query] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: register a plan under ``name`` with its SQL."""

        def keep(build):
            if name in self.found:
                raise ValueError(f"query registered twice: {name}")
            self.found[name] = Query(name, build, sql)
            return build

        return keep
