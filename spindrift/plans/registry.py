"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more_queries, table_queries  # noqa: F401  register their queries
from . import queries as _all


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event clusters of the articles in ``sf_dir`` with their attributes."""
    return _all.cluster_attrs(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_all.ORACLE)
