"""How queries are declared: a function over (spark, sf_dir) and its SQL twin, by one name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tonearm.functions.frames import plain_unions

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle_sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                plain_unions(spark)
                return f(spark, sf_dir)

            self.queries[f.__name__] = run
            if sql:
                self.oracle_sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
