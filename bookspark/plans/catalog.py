"""Named queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookspark.plans import documents, layers, relational, scalars

FLAGSHIP = "agg_missing_fields"
_ALL = scalars.QUERIES | relational.QUERIES | layers.QUERIES | documents.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
