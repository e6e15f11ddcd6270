"""Registry of named queries: a DataFrame builder and, where SQL can say it, the equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    builders: dict[str, Builder] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        def add(build: Builder) -> Builder:
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = build
            if sql:
                self.sql[name] = sql.strip()
            return build

        return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
