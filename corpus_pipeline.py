"""From raw documents to packed sequences: each stage works on what its predecessor kept.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents, further columns with whatever names among them.
An empty table stays empty through all stages. No stage looks at ids other than to choose among copies, so rows without
an id, or that share one, are kept and dropped by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm import exact_dedup, langid, packing, quality, simhash
from siftlake.llm.common import written
from siftlake.session import shipped


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty ones among them, and those that no learned language is likely for. Equal
    texts are judged alike; of equally likely languages the first by name counts."""
    return langid.keep_known(docs)


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of fewer than ten words, null and empty ones among them, and texts that repeat themselves, however long
    they are. Equal texts are judged alike."""
    return quality.keep_good(docs)


@shipped
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest id stays, one without an id only if none has one.
    Null texts are equal to empty ones. Of rows that repeat id and text, one stays."""
    return exact_dedup.keep_first(docs)


@shipped
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one with the smallest id stays; texts
    of fewer words are one shingle. Null and empty texts are copies of each other alone."""
    return simhash.keep_one(docs)


@shipped
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their place in sequences of 1024 tokens. A null or empty text is its end id
    alone; rows that repeat have pieces of their own."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages' models, suffix arrays, fingerprints and tokenizer; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents below sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
