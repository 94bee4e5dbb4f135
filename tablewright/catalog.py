"""Every query of the library outside the optional subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans import queries

FLAGSHIP = "export_document_rows"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(queries.ORACLE_SQL)
