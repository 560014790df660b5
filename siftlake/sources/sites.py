"""Scans of tables with a filter on key columns: files, or a database by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.operators.store import matching


def table(spark: SparkSession, path: str | None = None, jdbc: dict | None = None, **values) -> DataFrame:
    """Rows of a Parquet table or, with jdbc (url, dbtable and more), of a database; equalities reach the scan."""
    rows = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    return matching(rows, **values)


def backup(rows: DataFrame, folder: str, stamp: str) -> str:
    """A copy under a time stamp's name; its path."""
    path = f"{folder}/{stamp}"
    rows.write.parquet(path)
    return path
