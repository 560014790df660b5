"""JSON lines: dead letters, request logs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.lists import redacted
from siftlake.schemas import DLQ_MESSAGE, REQUEST_LOG

#: Folders of an export, each for the tenants with one remainder of a hash. A folder a tenant would make as many files as there are tenants in each task.
BUCKETS = 64


def bucket(site_id: Column) -> Column:
    return F.pmod(F.xxhash64(site_id.cast("long")), F.lit(BUCKETS)).cast("int")


def read_letters(spark: SparkSession, path: str, site_id: int | None = None) -> DataFrame:
    """Dead letters of a file, folder or glob; blank and malformed lines are left out. Below a folder that is partitioned
    by tenant, or by bucket of tenants as exports are, only the asked one's files are read."""
    rows = spark.read.schema(DLQ_MESSAGE).json(path, mode="DROPMALFORMED")
    rows = rows.filter(F.coalesce("timestamp", "site_id").isNotNull())
    if site_id is not None:
        rows = rows.filter(F.col("bucket") == bucket(F.lit(site_id))) if "bucket" in rows.columns else rows
        rows = rows.filter(F.col("site_id") == site_id)
    return rows.drop("bucket")


def export_letters(letters: DataFrame, path: str) -> None:
    """Letters as JSON lines, a folder for each bucket of tenants; a letter's line has its tenant."""
    letters.withColumn("bucket", bucket(F.col("site_id"))).write.mode("append").partitionBy("bucket").json(path)


def request_log(stream, path: str) -> DataFrame:
    """Request logs, from spark.read or spark.readStream, without secret headers."""
    return stream.schema(REQUEST_LOG).json(path).withColumn("headers", redacted(F.col("headers")))


def write_log(rows: DataFrame, path: str, most: int = 1_000_000) -> None:
    """Logs by day and hour, files of at most `most` rows."""
    dated = rows.withColumns({"date": F.to_date("timestamp"), "hour": F.hour("timestamp")})
    dated.write.mode("append").option("maxRecordsPerFile", most).partitionBy("date", "hour").json(path)
