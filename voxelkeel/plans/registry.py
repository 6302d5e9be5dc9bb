"""Registered queries: one Spark callable per key and, where SQL can say it, one oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelkeel.plans.bindings import Tables, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``, with its DuckDB text."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = with_bindings(oracle)
        return fn

    return register
