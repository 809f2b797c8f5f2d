"""Named queries, each with its builder and, where SQL can express it, the equivalent statement for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries in the order of their registration."""

    builders: dict[str, Builder] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        def add(builder: Builder) -> Builder:
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = builder
            if sql:
                self.sql[name] = sql
            return builder

        return add
