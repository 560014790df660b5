"""Written tables of a run below the shared folder: they cut the lineage and are read many times."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text for one task, where each becomes many rows.
PART = 4 << 20
_FOLDERS: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this run below spark.checkpoint.dir, which all executors share; one of its own only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.gettempdir()}/siftlake-shared"
        _FOLDERS[app] = f"{base.rstrip('/')}/siftlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone; the cluster's own cleaning takes over
        pass


class Scratch:
    """A written table that cuts the lineage: read it with df, remove it with drop() once nothing reads it. `by` are columns
    with a folder for each value."""

    def __init__(self, df: DataFrame, name: str, *by: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_folder(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.partitionBy(*by).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def dealt(df: DataFrame, *by: str, text: str | None = None, least: int = 0) -> DataFrame:
    """df dealt by columns to as many tasks as shuffles have, to `least` at least; with `text`, a column of texts that become many rows behind the
    shuffle, to so many that a task has about PART bytes of them. A given number keeps adaptive execution from joining
    partitions whose rows are few but become many behind the shuffle."""
    tasks = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if text is not None:
        tasks = max(tasks, (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART)
    return df.repartition(tasks, *by)


def written(df: DataFrame, name: str) -> DataFrame:
    return Scratch(df, name).df
