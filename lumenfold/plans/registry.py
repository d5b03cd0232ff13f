"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ["profiling", "domains", "comparing", "conflicting", "grouping", "building", "checking", "cells", "planning", "integrating", "retrieving", "batches", "embedding", "auditing", "answering", "streams"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def everything() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        import_module(f"lumenfold.plans.{module}")
    return QUERIES, ORACLES
