"""A registered query: how Spark runs it and, where SQL can say it, how DuckDB checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return self.build(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, as its files are cut."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
