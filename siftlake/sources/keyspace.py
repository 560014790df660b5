"""A dump of a key-value store as rows; the store stands behind a function that lists its entries."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a row can hold: the value by the key's kind.
SCHEMA = "key string, kind string, text string, items array<string>, fields map<string,string>, scores map<string,double>"


class Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class KeyspaceReader(DataSourceReader):
    """Reads files of one JSON object a line: key, kind (string, list, set, hash, zset) and value."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.paths]

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    yield entry(json.loads(line))


def entry(x: dict) -> tuple:
    kind, value = x["kind"], x["value"]
    return (
        x["key"],
        kind,
        value if kind == "string" else None,
        list(value) if kind == "list" else sorted(value) if kind == "set" else None,
        {str(k): str(v) for k, v in value.items()} if kind == "hash" else None,
        {str(k): float(v) for k, v in value.items()} if kind == "zset" else None,
    )


class Keyspace(DataSource):
    """spark.dataSource.register(Keyspace); spark.read.format("keyspace").option("paths", "a.jsonl,b.jsonl").load()"""

    @classmethod
    def name(cls) -> str:
        return "keyspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KeyspaceReader:
        return KeyspaceReader(self.options)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from files that Spark reads, split among tasks, wherever they lie."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    found = lines.select(F.from_json("value", "key string, kind string, value string").alias("e")).select("e.*")
    of = lambda kind, schema: F.when(F.col("kind") == kind, F.from_json("value", schema))
    return found.select(
        "key", "kind", F.when(F.col("kind") == "string", F.col("value")).alias("text"), F.coalesce(of("list", "array<string>"), F.array_sort(of("set", "array<string>"))).alias("items"),
        of("hash", "map<string,string>").alias("fields"), of("zset", "map<string,double>").alias("scores"),
    )


def dump(entries: DataFrame, path: str) -> None:
    """Rows as files that `rows` and the data source read."""
    value = F.coalesce(F.to_json("items").cast("string"), F.to_json("fields").cast("string"), F.to_json("scores").cast("string"))
    text = F.regexp_extract(F.to_json(F.struct("text")).cast("string"), r'^\{"text":(.*)\}$', 1)
    head = F.regexp_extract(F.to_json(F.struct("key", "kind")).cast("string"), r"^(.*)\}$", 1)
    entries.select(F.concat(head, F.lit(',"value":'), F.when(F.col("kind") == "string", text).otherwise(value), F.lit("}")).alias("value")).write.text(path)
