"""Every query of the engine by name, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapweave.plans import chain_queries, document_queries, reference_queries

_MODULES = (reference_queries, document_queries, chain_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for m in _MODULES for f in m.QUERIES}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
