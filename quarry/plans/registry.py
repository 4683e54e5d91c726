"""Every registered query of the engine, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, more


def settle(spark: SparkSession) -> None:
    """Spark 4.1's union claims the partitioning that its sides share, but adaptive execution may coalesce each
    side its own way; a grouping on top then splits groups. Measured on 4.1.2; off, a union claims nothing."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def _settled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        settle(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _settled(query) for name, query in (catalogue.QUERIES | more.QUERIES).items()}
SQL = catalogue.SQL | more.SQL
