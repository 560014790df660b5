"""Sentence boundaries learned from the texts themselves: which periods belong to their words.

A word whose period nearly always follows it is an abbreviation, by the ratio of the likelihoods that its period is its own
and that it is a sentence's end. Counts are aggregates over all texts; what is learned from them is small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How likely an abbreviation has its period, and the least score of one (the usual values of the method).
OWN, LEAST = 0.99, 0.3
#: The least share of a word's upper-case places that must begin a sentence, for it to be an opener.
OPENS = 0.9
#: Abbreviations and openers that a model keeps at most, the strongest first.
MOST = 20_000
#: A run without white space, and what of it is no part of a word; the period counts as one at the end.
RUN, AROUND = r"[^\x09-\x0D\x20]+", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
#: What may close a sentence behind its marks.
CLOSING = ")\\]}\"'”’»"
_END = re.compile(rf"([.!?]+)[{CLOSING}]*(?=\s|$)")
_NEXT = re.compile(r"\s+[^\w\s]*(\w\S*)?")
_AROUND = re.compile(r"^[^\w]+|[^\w.]+$")


def type_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """type, n, ended, lower, opened, opened_upper, upper: of each word without case and last period, how often it stands, stands
    with a period, begins in lower case and in upper case, and how often it
    begins a text or follows an end mark, in upper case too."""
    runs = lambda pattern, group: F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    every = texts.select(runs(RUN, 0).alias("run"), F.lit(0).alias("after"))
    after = texts.select(runs(rf"(?:^[\x09-\x0D\x20]*|(?<=[.!?])[{CLOSING}]*[\x09-\x0D\x20]+)({RUN})", 1).alias("run"), F.lit(1).alias("after"))
    bare = every.unionByName(after).groupBy("run", "after").count().withColumn("bare", F.regexp_replace("run", AROUND, ""))
    rows = bare.select(F.regexp_replace(F.lower("bare"), r"\.$", "").alias("type"), "count", "after", F.col("bare").endswith(".").alias("ended"), F.col("bare").rlike(r"^\p{Lu}").alias("upper"))
    of = lambda test: F.sum(F.when(test, F.col("count")).otherwise(0))
    here, then = F.col("after") == 0, F.col("after") == 1
    counts = rows.filter(F.col("type").rlike(r"\p{L}")).groupBy("type").agg(
        of(here).alias("n"), of(here & F.col("ended")).alias("ended"), of(here & ~F.col("upper")).alias("lower"), of(here & F.col("upper")).alias("upper"), of(then).alias("opened"), of(then & F.col("upper")).alias("opened_upper")
    )
    return counts.filter("n > 0")


def own_period(ended: Column, n: Column, share: Column) -> Column:
    """Twice the logarithm of the ratio of likelihoods: a period that is the word's own against one that comes to any word."""
    likelihood = lambda p: ended * F.log(p) + (n - ended) * F.log(1 - p)
    return 2 * (likelihood(F.lit(OWN)) - likelihood(share))


def scored(counts: DataFrame) -> DataFrame:
    """counts with ratio and score: the ratio is weighed down for long words and for each time a word stands without its period,
    and up for periods inside."""
    total = counts.agg((F.sum("ended") / F.sum("n")).alias("share"))
    letters = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    ratio = own_period(F.col("ended"), F.col("n"), F.col("share"))
    met = counts.crossJoin(F.broadcast(total)).filter("share > 0 and share < 1").withColumn("ratio", ratio)
    score = F.col("ratio") * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), F.col("ended") - F.col("n"))
    return met.withColumn("score", score).drop("share")


@dataclass(frozen=True)
class Boundaries:
    """What was learned: abbreviations, and openers, words that are in lower case unless they begin a sentence."""

    abbreviations: frozenset[str] = field(default_factory=frozenset)
    openers: frozenset[str] = field(default_factory=frozenset)

    def ends(self, word: str, marks: str, after: str | None) -> bool:
        """Whether marks behind a word end a sentence, given the word after them."""
        if after is None or "!" in marks or "?" in marks:
            return True
        bare = _AROUND.sub("", word)
        kind, upper = bare.lower(), after[:1].isupper()
        if len(marks) > 1:  # an ellipsis
            return upper
        initial = len(bare) == 1 and bare.isupper() or bool(re.fullmatch(r"(\w\.)+\w", bare))
        if initial:
            return upper and len(bare) > 1 and _AROUND.sub("", after).lower().removesuffix(".") in self.openers
        if bare.isdigit() and not upper and after[:1].isalpha():
            return False  # an ordinal
        if kind in self.abbreviations:
            return upper and _AROUND.sub("", after).lower().removesuffix(".") in self.openers
        return True

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of each sentence without the white space around it; together they hold all else of the text. A period
        inside a number, a name or an address is no end, since no white space follows it."""
        spans, begin = [], 0
        for m in _END.finditer(text):
            nxt = _NEXT.match(text, m.end())
            after = nxt[1] if nxt else None
            word = re.split(r"\s", text[max(begin, m.start() - 64) : m.start()])[-1]
            if nxt is None or self.ends(word, m[1], after if after is not None else "A"):
                spans.append((begin, m.end()))
                begin = m.end()
        spans.append((begin, len(text)))
        trimmed = ((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in spans)
        return [(a, b) for a, b in trimmed if a < b]


def learned(texts: DataFrame, text: str = "text") -> Boundaries:
    """A model of a table's texts; nulls count as no text. An empty table gives a model that knows no abbreviation."""
    counts = scored(type_counts(texts, text)).cache()
    try:
        short = counts.filter(f"ended > 0 and score >= {LEAST}").orderBy(F.desc("score"), "type").limit(MOST).select("type").collect()
        opens = counts.filter(f"lower > 0 and opened_upper > 0 and opened_upper >= {OPENS} * upper").orderBy(F.desc("opened_upper"), "type").limit(MOST).select("type").collect()
    finally:
        counts.unpersist()
    return Boundaries(frozenset(r.type for r in short), frozenset(r.type for r in opens))
