"""Language by rank-order profiles: how far a text's most frequent letter sequences are out of place in each language's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.text import detection_text
from siftlake.scratch import dealt, written

#: Letters of a sequence at most, and sequences of a profile.
LONGEST, TOP = 3, 400
#: Sequences that a text is known by at most.
SEEN = 300


def gram_ranks(rows: DataFrame, keys: list[str], top: int, text: str = "text") -> DataFrame:
    """keys, gram, rank (from 1): the most frequent sequences of up to LONGEST letters in the words of a key's rows, in lower case,
    a word's ends marked; ties by the sequence. Equal words are counted before they are cut into sequences."""
    words = rows.select(*keys, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{M}]+")).alias("word")).filter("word <> ''")
    counted = words.groupBy(*keys, "word").count().select(*keys, "count", F.concat(F.lit("_"), "word", F.lit("_")).alias("word"))
    at = counted.select(*keys, "count", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    sizes = F.explode(F.array(*[F.when(F.col("i") + k - 1 <= F.length("word"), F.lit(k)) for k in range(1, LONGEST + 1)]))
    grams = at.select(*keys, "count", "word", "i", sizes.alias("k")).filter("k is not null").select(*keys, "count", F.substring("word", F.col("i"), F.col("k")).alias("gram"))
    sums = grams.filter("gram <> '_'").groupBy(*keys, "gram").agg(F.sum("count").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))
    return sums.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select(*keys, "gram", "rank")


def learned(texts: DataFrame, language: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """language, gram, place: the profile of each language that a table's rows name; rows without one teach nothing. At most `top`
    rows a language. Words are counted by language first, so that a language that most rows have is many tasks."""
    named = texts.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.col(text).alias("text"))
    return written(gram_ranks(named, ["language"], top).withColumnRenamed("rank", "place"), "profiles")


def languages(rows: DataFrame, keys: list[str], profiles: DataFrame, text: str = "text", top: int = TOP, whole: bool = False) -> DataFrame:
    """keys, language, distance of each row, by what detection_text keeps of its text or by the whole text.

    A sequence of the text counts the difference of its ranks, or `top` where the profile lacks it; the language with the
    smallest sum counts, ties by name. Language and distance are null where the text has no letter or the profiles none of
    its sequences. keys tell rows apart. Profiles are small: they are broadcast, `top` rows a language.
    """
    seen = F.col(text) if whole else detection_text(F.col(text))
    own = gram_ranks(dealt(rows.select(*keys, seen.alias("text")), *keys), keys, SEEN)
    size = F.count("*").over(Window.partitionBy(*keys))
    met = own.withColumn("_size", size).join(F.broadcast(profiles), "gram")
    gain = F.sum(F.abs(F.col("rank") - F.col("place")) - top)
    sums = met.groupBy(*keys, "language").agg((F.first("_size") * top + gain).alias("distance"))
    best = sums.groupBy(*keys).agg(F.min(F.struct("distance", "language")).alias("_best"))
    return rows.select(*keys).join(best, keys, "left").select(*keys, F.col("_best.language").alias("language"), F.col("_best.distance").alias("distance"))
