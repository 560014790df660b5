"""Dense search: exact cosine top-k by tenant, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that are scored together with a tenant's queries, about, and queries that one product takes.
BLOCK, QUERIES = 20_000, 512


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, tenant: str = "site_id", vec_id: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, tenant, vec_id, score, rank: the k vectors of each query's tenant with the largest cosine.

    queries: query_id, tenant, vector. A tenant's vectors are dealt to blocks of about BLOCK rows, and its queries go to
    each of them; a block sends k rows for a query. So a tenant with a third of all vectors takes many tasks, and no
    side is broadcast. Scores are rounded to `digits`, ties go to the smaller id. Null vectors match nothing.
    """
    sizes = vectors.groupBy(tenant).agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("_blocks"))
    right = vectors.filter(F.col(vector).isNotNull()).join(sizes, tenant).select(tenant, F.pmod(F.xxhash64(vec_id), F.col("_blocks")).cast("int").alias("_block"), vec_id, vector)
    asked = queries.select(*[F.col(c).alias(c) for c in (tenant, "query_id", vector)])  # the two sides may come from one table
    left = asked.filter(F.col(vector).isNotNull()).join(sizes.select(F.col(tenant).alias(tenant), F.col("_blocks").alias("_blocks")), tenant).select(F.col(tenant).alias(tenant), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "query_id", vector)

    def within(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        found = ([], [], [])
        if q.num_rows and v.num_rows:
            ids, names = v.column(vec_id).to_numpy(), q.column("query_id").to_numpy()
            x, y = unit(matrix(v.column(vector))), unit(matrix(q.column(vector)))
            for at in range(0, len(y), QUERIES):
                scores = np.round(y[at : at + QUERIES] @ x.T, digits)
                for name, row in zip(names[at : at + QUERIES], scores, strict=True):
                    best = np.lexsort((ids, -row))[:k] if len(row) <= 4 * k else _best(row, ids, k)
                    found[0].append(np.full(len(best), name))
                    found[1].append(ids[best])
                    found[2].append(row[best])
        columns = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
        site = pa.array([key[0].as_py()] * len(columns[0]), q.schema.field(tenant).type)
        return pa.table([site, *map(pa.array, columns)], names=[tenant, "query_id", vec_id, "score"])

    kind = dict(vectors.dtypes)[tenant]
    scored = left.groupBy(tenant, "_block").cogroup(right.groupBy(tenant, "_block")).applyInArrow(within, f"`{tenant}` {kind}, query_id long, `{vec_id}` long, score double")
    rank = F.row_number().over(Window.partitionBy(tenant, "query_id").orderBy(F.desc("score"), vec_id))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k largest, ties by id: all that reach the k-th value, sorted."""
    least = np.partition(row, len(row) - k)[len(row) - k]
    some = np.flatnonzero(row >= least)
    return some[np.lexsort((ids[some], -row[some]))[:k]]
