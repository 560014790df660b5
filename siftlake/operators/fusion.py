"""Fusion of ranked lists and the final cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion and the first rank; the server that the platform asks has its own.
RRF_K, FIRST_RANK = 2, 0


def rrf(lists: list[DataFrame], doc: str, k: int = RRF_K, limit: int = 20, first: int = FIRST_RANK) -> DataFrame:
    """query_id, doc, score, rank: the sum of 1 / (k + rank) over lists (query_id, doc, rank from 1), cut to `limit`.

    What one list alone has counts once, so nothing is joined.
    """
    one = reduce(DataFrame.unionByName, [x.select("query_id", doc, "rank") for x in lists])
    fused = one.groupBy("query_id", doc).agg(F.sum(1.0 / (k + F.col("rank") - 1 + first)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), doc))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= limit)


def best_of(results: DataFrame, limit: int, by: list[str], digits: int = 9) -> DataFrame:
    """All results of a search sorted by score, one row per chunk, the first `limit`; ties by the columns in `by`."""
    return results.orderBy(F.desc(F.round("score", digits)), *by).limit(limit)


def hybrid(dense: DataFrame, sparse: DataFrame, doc: str, prefetch: int, limit: int) -> DataFrame:
    """Both lists cut to `prefetch`, fused, cut to `limit`."""
    cut = lambda x: x.filter(F.col("rank") <= prefetch)
    return rrf([cut(dense), cut(sparse)], doc, limit=limit)


def scored_only(results: DataFrame, doc: str = "id", score: str = "score") -> DataFrame:
    """Results that have an id and a score that can be read."""
    return results.withColumn(score, F.col(score).try_cast("double")).filter(F.col(doc).isNotNull() & F.col(score).isNotNull())
