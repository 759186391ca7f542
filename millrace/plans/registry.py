"""Queries over the driver tables, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import curation_queries, evaluation_queries, run_queries

_ALL = {**curation_queries.QUERIES, **evaluation_queries.QUERIES, **run_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
