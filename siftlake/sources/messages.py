"""Source trees and translation files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source_lines(spark: SparkSession, path: str, pattern: str = "*.php") -> DataFrame:
    """file, line (from 1) and text of all files below path. A file is one row until its lines are split."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def po_entries(lines: DataFrame) -> DataFrame:
    """msgid, msgstr, plural and forms of a PO file's lines (file, line, text); continued strings are joined. An entry with
    plural forms has them all in forms, by number, and the first one as its msgstr."""
    kind = F.regexp_extract("text", r'^\s*(msgid_plural|msgid|msgstr(?:\[\d+\])?)\s*"', 1)
    value = F.regexp_extract("text", r'"(.*)"\s*$', 1)
    rows = lines.filter(F.col("text").rlike(r'^\s*(msgid_plural|msgid|msgstr(\[\d+\])?)?\s*"')).withColumns({"kind": kind, "value": value})
    w = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumn("entry", F.sum((F.col("kind") == "msgid").cast("int")).over(w)).withColumn("part", F.sum((F.col("kind") != "").cast("int")).over(w))
    parts = rows.groupBy("file", "entry", "part").agg(F.max("kind").alias("kind"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "").alias("value"))
    number = F.regexp_extract("kind", r"\[(\d+)\]", 1).try_cast("int")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    forms = F.transform(F.sort_array(F.collect_list(F.when(number.isNotNull(), F.struct(number.alias("n"), "value")))), lambda x: x["value"])
    out = parts.groupBy("file", "entry").agg(of("msgid").alias("msgid"), of("msgstr").alias("msgstr"), of("msgid_plural").alias("plural"), forms.alias("forms"))
    return out.filter("msgid <> ''").select("file", "msgid", F.coalesce("msgstr", F.get("forms", F.lit(0))).alias("msgstr"), "plural", "forms")
