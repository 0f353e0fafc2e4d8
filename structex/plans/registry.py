"""All registered queries of the extraction engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from structex.plans import queries_documents, queries_replies, queries_streams

MODULES = (queries_documents, queries_replies, queries_streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.SQL
    return found
