"""Request logs as files by pod, day and hour, each of at most so many bytes; the oldest files of a pod go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.lists import oldest_beyond
from siftlake.operators.running import running
from siftlake.scratch import written

#: Bytes of a log file at most, as the platform has it, and files that a pod keeps.
MOST_BYTES, KEPT = 100 << 20, 5


def rotated(lines: DataFrame, group: list[str], order: list[str], most: int = MOST_BYTES) -> DataFrame:
    """lines (a column line, group and order among others) with size (bytes, the line's end included), file and begins: lines of
    a group go to files one after another, none with more than `most` bytes unless one line alone has more.

    A line's file follows from the bytes before it in its group, by running sums over ranges: a pod with a third of all
    lines is many tasks, and no line waits for the one before. Files are filled up to `most` less the longest line.
    Group columns are not null; lines that agree in group and order are in no particular order.
    """
    sized = written(lines.withColumn("size", (F.octet_length("line") + 1).cast("long")), "log-lines")
    longest = sized.agg(F.max("size")).first()[0] or 0
    step = max(1, most - longest + 1)
    placed = running(sized, order, {"_upto": "size"}, group=tuple(group))
    return placed.withColumn("begins", F.col("_upto") - F.col("size")).withColumn("file", F.floor(F.col("begins") / step)).drop("_upto")


def write_logs(lines: DataFrame, path: str, pod: str, at: Column, order: list[str], most: int = MOST_BYTES) -> None:
    """Appends lines below path as pod/date/hour/file. Each file is one task's; Spark's committer shows files of finished jobs
    alone, so a task that fails or is lost leaves none. order are columns of lines that numbers or times sort."""
    dated = lines.withColumns({"pod": F.coalesce(F.col(pod).cast("string"), F.lit("none")), "date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")})
    folders = ["pod", "date", "hour"]
    kept = dated.fillna("none", ["date", "hour"]).select(*folders, *order, "line")
    out = rotated(kept, folders, order, most).select(*folders, "file", "begins", "line")
    dealt = out.repartition(*folders, "file").sortWithinPartitions(*folders, "file", "begins")
    dealt.select(*folders, "file", "line").write.mode("append").partitionBy(*folders, "file").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """directory (a pod's), name (path from there), mtime and bytes of all log files. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))
    return found.select(F.regexp_extract("path", "/pod=([^/]*)/", 1).alias("directory"), F.regexp_extract("path", "/pod=[^/]*/(.*)$", 1).alias("name"), "mtime", "bytes", "path")


def retired(spark: SparkSession, path: str, keep: int = KEPT) -> DataFrame:
    """The files that go so that each pod keeps its newest, ties by name."""
    return oldest_beyond(files(spark, path), keep)
