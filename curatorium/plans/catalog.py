"""The registered queries and the SQL that states the same results.

Each module of this package adds its queries to QUERIES and, where SQL can express them, the same results in DuckDB's SQL to ORACLES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatorium.plans import articles, content, golden, merging, records, runs, serving, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**web.QUERIES, **serving.QUERIES, **records.QUERIES, **golden.QUERIES, **content.QUERIES, **articles.QUERIES, **runs.QUERIES, **merging.QUERIES}
ORACLES: dict[str, str] = {**web.ORACLES, **serving.ORACLES, **records.ORACLES, **golden.ORACLES, **content.ORACLES, **articles.ORACLES, **runs.ORACLES, **merging.ORACLES}
