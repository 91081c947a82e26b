"""All queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import file_queries, line_queries, syntax_queries  # noqa: F401 - file_queries registers its own

QUERIES = line_queries.QUERIES | syntax_queries.QUERIES
ORACLES = line_queries.ORACLES | syntax_queries.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every file by severity."""
    return QUERIES["severity_summary"](spark, sf_dir)
