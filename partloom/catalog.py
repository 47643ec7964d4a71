"""Registry of the queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evidence, functional, mappings, store  # noqa: F401  (they register their queries)
from .plans.queries import Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q.spark for name, q in Q.items()} | functional.QUERIES
ORACLE_SQL: dict[str, str] = {name: q.duck() for name, q in Q.items()} | functional.ORACLE_SQL
FLAGSHIP = "cells_by_method"
