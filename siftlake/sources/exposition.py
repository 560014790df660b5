"""Metrics as services expose them: text lines with types, labels and escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
SAMPLE = rf'^({NAME})\s*(?:\{{((?:[^"}}]|"(?:[^"\\]|\\.)*")*)\}})?\s+(\S+)(?:\s+(-?\d+))?\s*$'
TYPE = rf"^#\s*TYPE\s+({NAME})\s+(\w+)\s*$"
#: What the samples of a metric with parts add to its name.
PARTS = "_(?:bucket|sum|count)$"
#: Stands for an escaped backslash while other escapes are replaced.
HELD = "\x01"


def unescaped(value: Column) -> Column:
    """Escaped backslashes, quotes and line ends of a label's value as themselves."""
    held = F.replace(value, F.lit("\\\\"), F.lit(HELD))
    held = F.replace(F.replace(held, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(held, F.lit(HELD), F.lit("\\"))


def number(text: Column) -> Column:
    """A sample's value; NaN and infinities have names of their own; null for what is no number."""
    low = F.lower(text)
    named = F.when(low == "nan", float("nan")).when(low.isin("+inf", "inf"), float("inf")).when(low == "-inf", float("-inf"))
    return F.coalesce(named, F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")))


def samples(scrapes: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no, metric, labels (a map), value, at_ms, type: the samples of each scrape (keys, text).

    A sample's type is what the last TYPE line of its scrape that names its metric says, else `untyped`; samples
    of histograms and summaries have their metric's. Blank lines, comments and lines that are no sample are left out. Of
    equal labels the last one counts. A null or empty scrape has no samples.
    """
    lines = scrapes.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))
    part = lambda i: F.regexp_extract("line", SAMPLE, i)
    kind = lambda i: F.regexp_extract("line", TYPE, i)
    told = lines.filter(F.col("line").rlike(TYPE)).groupBy(*keys, kind(1).alias("base")).agg(F.max_by(kind(2), F.col("line_no")).alias("type"))
    found = lines.filter(F.col("line").rlike(SAMPLE)).select(*keys, "line_no", part(1).alias("metric"), part(2).alias("inside"), number(part(3)).alias("value"), F.when(part(4) != "", part(4).try_cast("bigint")).alias("at_ms"))
    pairs = F.arrays_zip(F.regexp_extract_all("inside", F.lit(LABEL), F.lit(1)).alias("k"), F.regexp_extract_all("inside", F.lit(LABEL), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    labels = F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], unescaped(x["v"]))))
    found = found.filter("value is not null").withColumn("labels", labels).drop("inside")
    own = told.withColumnRenamed("base", "metric")
    whole = told.filter("type in ('histogram', 'summary')").withColumnRenamed("base", "_base").withColumnRenamed("type", "_type")
    met = found.withColumn("_base", F.regexp_replace("metric", PARTS, "")).join(own, [*keys, "metric"], "left").join(whole, [*keys, "_base"], "left")
    return met.select(*keys, F.col("line_no").cast("long").alias("line_no"), "metric", "labels", "value", "at_ms", F.coalesce("type", "_type", F.lit("untyped")).alias("type"))
