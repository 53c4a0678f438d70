"""The queries of the engine, by name, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argentum.plans import develop_queries, file_queries, harness_queries, pixel_queries, relation_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**pixel_queries.QUERIES, **relation_queries.QUERIES, **file_queries.QUERIES, **harness_queries.QUERIES, **develop_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**pixel_queries.SQL, **relation_queries.SQL, **file_queries.SQL, **harness_queries.SQL, **develop_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast by table join, error metrics by channel with exact ranks, grade."""
    return pixel_queries.graded_contrast(spark, sf_dir)
