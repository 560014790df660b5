"""Rows of the admin side: attributes, lists, menus, messages, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.scratch import written


def attributes(meta: DataFrame, oid: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """One row per object, a column for each key: its values as a sorted list, null without any."""
    return meta.groupBy(oid).pivot(key, keys).agg(F.sort_array(F.collect_list(value)))


def single(values: Column) -> Column:
    """The value if there is one."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def positioned(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their position in an order, from 1: ranges of the order are numbered by themselves and begin after the sizes
    of the ranges before, so that no task holds all rows."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn("position", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def sort_list(rows: DataFrame, by: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Position by a column, text without regard to case."""
    text = dict(rows.dtypes)[by] == "string"
    value = F.lower(by) if text else F.col(by)
    return positioned(rows, *([value.desc(), F.desc(tie)] if descending else [value.asc(), F.asc(tie)]))


def message_references(lines: DataFrame, text: str = "text") -> DataFrame:
    """msgid and its sorted `file:line` places, from lines (file, line, text) with markers like _('message')."""
    found = F.regexp_extract_all(text, F.lit(r"_\('([^']*)'\)"), F.lit(1))
    return lines.select(F.explode(found).alias("msgid"), F.concat_ws(":", "file", "line").alias("ref")).groupBy("msgid").agg(F.sort_array(F.collect_list("ref")).alias("refs"))


def children(pages: DataFrame) -> DataFrame:
    """slug and its child pages in order, for pages (slug, parent, ord)."""
    below = pages.filter("parent is not null").groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("ord", "slug"))).alias("c"))
    return pages.alias("p").join(below.alias("b"), F.col("p.slug") == F.col("b.parent"), "left").select("p.slug", F.coalesce(F.col("b.c.slug"), F.array().cast("array<string>")).alias("children"))


def translations(messages: DataFrame, locales: list[str]) -> DataFrame:
    """msgid and a column for each locale."""
    return messages.groupBy("msgid").pivot("locale", locales).agg(F.max("text"))


def oldest_beyond(files: DataFrame, keep: int, key: str = "directory") -> DataFrame:
    """Files to remove so that each directory keeps its newest."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mtime"), F.desc("name")))
    return files.withColumn("_n", newest).filter(F.col("_n") > keep).drop("_n")


def merged_metadata(*maps: Column) -> Column:
    """Maps as one; of equal keys the last map's stays."""
    out = maps[0]
    for m in maps[1:]:
        out = _over(out, m)
    return out


def _over(below: Column, above: Column) -> Column:
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def redacted(headers: Column) -> Column:
    """Request headers without the one that holds a secret."""
    return F.map_filter(headers, lambda k, v: F.lower(k) != "authorization")


def subword_merge(tokens: Column, weights: Column) -> Column:
    """Words from sub-word pieces as (word, weight): pieces that don't begin with the word mark, longer than one character,
    continue the word before; special tokens go; a first piece that would continue begins a word."""
    mark, special = "▁", ("<s>", "</s>", "<pad>", "<unk>")
    pairs = F.filter(F.arrays_zip(tokens.alias("t"), weights.alias("w")), lambda x: ~x["t"].isin(*special))
    clean = lambda t: F.when(t.startswith(mark) & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t))).otherwise(t)
    goes_on = lambda acc, t: (F.size(acc) > 0) & (F.length(t) > 1) & ~t.startswith(mark)
    word = lambda t, w: F.struct(t.alias("word"), w.cast("double").alias("weight"))

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(word(F.concat(last["word"], clean(x["t"])), last["weight"] + x["w"])))
        return F.when(goes_on(acc, x["t"]), joined).otherwise(F.concat(acc, F.array(word(clean(x["t"]), x["w"]))))

    return F.aggregate(pairs, F.expr("cast(array() as array<struct<word:string,weight:double>>)"), add)


def removed_first(values: Column, value: Column) -> Column:
    """An array without the first element that equals value."""
    at = F.array_position(values, value).cast("int")
    return F.when(at > 0, F.concat(F.slice(values, F.lit(1), at - 1), F.slice(values, at + 1, F.size(values)))).otherwise(values)


def named(code: Column, names: dict[str, str]) -> Column:
    """A code's name from a table of names, or the code."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code)
