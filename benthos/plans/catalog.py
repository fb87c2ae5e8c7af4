"""All registered queries with their SQL, gathered from the modules of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benthos.plans import admission_queries, evidence_queries, feature_queries, join_queries, rule_queries, split_queries  # noqa: F401
from benthos.plans.registry import QUERIES, SQL, Tables


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star join, unit rule, log target, merge and robust spread in one plan."""
    return split_queries.slice_query(Tables(spark, sf_dir))
