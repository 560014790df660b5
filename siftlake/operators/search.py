"""Search and storage from texts on: chunks, both kinds of vectors, ranked lists, their fusion and the last cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.operators import dense, embedding, fusion, sparse
from siftlake.operators.chunking import chunk_documents
from siftlake.scratch import written

#: Chunks of a query's text: characters and overlap.
SIZE, OVERLAP = 512, 128


def with_vectors(chunks: DataFrame, model: str = "arctic", mode: str = "store", language: Column | None = None) -> DataFrame:
    """chunks (text and more) with dense, sparse and error: a chunk that the model fails on has an error and no vectors; a
    model without sparse vectors leaves them null. A null text has neither vectors nor an error."""
    terms = embedding.sparse_vector("text") if embedding.MODELS[model].sparse else F.lit(None).cast("map<bigint,float>")
    made = embedding.embed_or_fail(chunks.withColumn("_terms", terms), model, mode, language=language)
    return made.withColumn("sparse", F.when(F.col("error").isNull(), F.col("_terms"))).drop("_terms")


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks as a written table, so that the model is called once for each."""
    return written(chunks, "chunks")


def dense_list(asked: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, point_id, rank by cosine within the tenant."""
    return dense.dense_topk(asked.select("query_id", "site_id", "dense"), chunks.select("site_id", "point_id", "dense"), limit, vec_id="point_id", vector="dense")


def sparse_list(asked: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, point_id, rank by idf-weighted terms within the tenant."""
    terms = lambda rows, key, weight: rows.select("site_id", key, F.explode("sparse").alias("term", weight))
    sizes = chunks.groupBy("site_id").agg(F.count("*").alias("n"))
    return sparse.sparse_topk(terms(asked, "query_id", "qw"), terms(chunks, "point_id", "dw"), sizes, limit, doc="point_id")


def search(queries: DataFrame, chunks: DataFrame, model: str = "arctic", limit: int = 20, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """query_id, site_id, point_id, score, rank: the best `limit` results of each query in its tenant.

    queries: query_id, site_id, text, language. chunks: site_id, point_id, dense and sparse, as stored. A query's text is
    cut into chunks; for each, the list by vectors and the list by terms, both cut to `limit`, are fused; the results of all
    chunks of a query are sorted by score, ties by point. A query without text, or whose tenant has no chunks, has no result.
    """
    cut = chunk_documents(queries.select("query_id", "site_id", "language", "text"), size, overlap)
    cut = with_vectors(cut, model, "search", F.col("language")).withColumnRenamed("query_id", "asked")
    cut = written(cut.withColumn("query_id", F.xxhash64("asked", "site_id", "offset")), "asked")
    fused = fusion.rrf([dense_list(cut, chunks, limit), sparse_list(cut, chunks, limit)], "point_id", limit=limit)
    whole = fused.drop("rank").join(cut.select("query_id", "asked", "site_id"), "query_id")
    rank = F.row_number().over(Window.partitionBy("asked", "site_id").orderBy(F.desc(F.round("score", 9)), "point_id", "query_id"))
    return whole.withColumn("rank", rank).filter(F.col("rank") <= limit).select(F.col("asked").alias("query_id"), "site_id", "point_id", "score", "rank")
