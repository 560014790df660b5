"""The chunk table: upserts and deletes as plans over its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.codecs import point_id

KEY = ["site_id", "post_id", "offset"]


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Of rows with one key, the last in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, key: list[str] = KEY, order: str | None = None, replace_document: bool = False) -> DataFrame:
    """The table after the changes: rows with a changed key are replaced, others stay.

    replace_document also drops the chunks of changed documents that the changes don't have any more. order: which of
    changes with one key counts, the largest.
    """
    new = latest(changes, key, F.col(order)) if order else changes.dropDuplicates(key)
    gone = ["site_id", "post_id"] if replace_document else key
    kept = table.join(changes.select(*gone).distinct(), gone, "left_anti")
    return kept.unionByName(new.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the rows whose columns of keys match: whole documents, single chunks or tenants."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def with_point_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("point_id", point_id(F.col("post_id"), F.col("offset")))


def offsets(chunks: DataFrame) -> DataFrame:
    """site_id, post_id and the sorted offsets of its chunks."""
    return chunks.groupBy("site_id", "post_id").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))


def write(chunks: DataFrame, path: str) -> None:
    """Replaces the partitions of the tenants that chunks has and no others. The path must not be one that chunks reads."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path)


def matching(table: DataFrame, **values) -> DataFrame:
    """Rows where all given columns have the given values; all rows without any."""
    return table.filter(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()], F.lit(True)))
