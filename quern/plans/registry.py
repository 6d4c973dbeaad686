"""All queries by name, with the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import content, feedback, search, service, store, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (vectors, search, feedback, content, store, service):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
