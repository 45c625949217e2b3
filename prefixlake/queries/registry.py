"""Registered queries: each operator run over whole tables, with equivalent SQL.

Every entry of ``QUERIES`` takes (spark, directory of the given tables). The
entry of the same name in ``ORACLES`` is the same question as plain SQL.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefixlake.fixtures import duckdb_sql
from prefixlake.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-15 00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        @functools.wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return build

    return register
