"""All registered queries, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as _queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from pages of postings to scored postings."""
    return _queries.QUERIES["process_postings"](spark, sf_dir)


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.ORACLES)
