"""Search: dense, sparse, fused."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftlake.functions import vectors as V
from siftlake.operators import dense, fusion, sparse
from siftlake.plans.inputs import table
from siftlake.plans.registry import query
from siftlake.scratch import written

#: The query set of vectors and documents: every row whose id is divisible by this, against all rows.
EVERY = 50
STOP = "(" + ", ".join(f"'{w}'" for w in sparse.STOPWORDS) + ")"
DENSE_SQL = f"""dense AS (
  SELECT query_id, site_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.label AS site_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score
        FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % {EVERY} = 0)
  QUALIFY rank <= 10)"""
TERMS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS term"
TERMS_SQL = f"""terms AS (
  SELECT site_id, doc_id, term, count(*) AS tf FROM (SELECT source AS site_id, doc_id, {TERMS} FROM documents) WHERE term NOT IN {STOP} GROUP BY ALL),
n AS (SELECT source AS site_id, count(*) AS n FROM documents GROUP BY 1),
dw AS (SELECT site_id, doc_id, term, tf * 1.0 / sum(tf) OVER (PARTITION BY site_id, doc_id) AS w FROM terms),
df AS (SELECT site_id, term, count(*) AS df FROM terms GROUP BY 1, 2)"""
SCORED_SQL = """scored AS (SELECT query_id, dw.site_id, dw.doc_id, sum(qw.w * ln((n - df + 0.5) / (df + 0.5) + 1) * dw.w) AS score
  FROM qw JOIN dw USING (site_id, term) JOIN df USING (site_id, term) JOIN n USING (site_id) GROUP BY 1, 2, 3),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id, site_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)"""
#: Every benchmark item asked, asked of each tenant.
SPARSE_SQL = f"""{TERMS_SQL},
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, {TERMS} FROM benchmark) WHERE term NOT IN {STOP} GROUP BY item_id, term),
qw AS (SELECT item_id AS query_id, site_id, term, tf * 1.0 / sum(tf) OVER (PARTITION BY item_id, site_id) AS w FROM qt, n),
{SCORED_SQL}"""


def dense_rows(spark, sf_dir, k=10):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("site_id"), "vec_id", "embedding")
    q = v.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return dense.dense_topk(q, v, k)


def by_tenant(spark, sf_dir, *columns):
    """Documents with their source as the tenant."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("site_id"), "doc_id", *columns)


def weighted(rows, *keys):
    return sparse.count_weights(sparse.term_counts(rows, list(keys)), list(keys))


def packed_of(docs):
    """All documents' terms, written once and read many times."""
    return written(sparse.packed_weights(sparse.term_counts(docs, ["site_id", "doc_id"]), ["site_id", "doc_id"]), "packed")


def sparse_rows(spark, sf_dir, k=10):
    """Every benchmark item, asked of each tenant: so many queries reach all documents, so there is no index."""
    docs = by_tenant(spark, sf_dir, "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = sparse.packed_weights(sparse.term_counts(asked, ["query_id"]), ["query_id"])
    return sparse.blocked_topk(asked, packed_of(docs), docs.groupBy("site_id").agg(F.count("*").alias("n")), k)


@query(f"WITH {DENSE_SQL} SELECT query_id, site_id, vec_id, score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return dense_rows(spark, sf_dir).select("query_id", "site_id", "vec_id", "score", "rank")


@query(f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score
FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d QUALIFY rank <= 5""")
def dense_topk_filtered(spark, sf_dir):
    """The five nearest of each query's tenant but itself."""
    found = dense_rows(spark, sf_dir, 6).filter("vec_id <> query_id").select("query_id", "vec_id", "score", "rank")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", again).filter("rank <= 5")


@query(f"WITH {TERMS_SQL} SELECT doc_id, term, round(tf * 1.0 / sum(tf) OVER (PARTITION BY doc_id), 9) AS weight FROM terms")
def sparse_terms_l1(spark, sf_dir):
    return weighted(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id").withColumn("weight", F.round("weight", 9))


@query(f"WITH {SPARSE_SQL} SELECT query_id, site_id, doc_id, round(score, 6) AS score, rank FROM sparse")
def sparse_idf_topk(spark, sf_dir):
    return sparse_rows(spark, sf_dir).select("query_id", "site_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {TERMS_SQL},
t AS (SELECT * FROM terms WHERE length(term) >= 2), size AS (SELECT site_id, doc_id, sum(tf) AS len FROM t GROUP BY 1, 2), mean AS (SELECT site_id, avg(len) AS a, count(*) AS m FROM size GROUP BY 1), tdf AS (SELECT site_id, term, count(*) AS df FROM t GROUP BY 1, 2),
w AS (SELECT doc_id, term, round(ln((m - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)), 9)::DECIMAL(18, 9) AS w FROM t JOIN size USING (site_id, doc_id) JOIN tdf USING (site_id, term) JOIN mean USING (site_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS r FROM w QUALIFY r <= 128)
SELECT doc_id, count(*) AS terms, round(max(w::DOUBLE / total::DOUBLE), 6) AS heaviest FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS total FROM kept) GROUP BY doc_id""")
def sparse_bm25(spark, sf_dir):
    kept = sparse.blocked_bm25(by_tenant(spark, sf_dir, "text"))
    return kept.groupBy("doc_id").agg(F.sum(F.size("terms")).alias("terms"), F.round(F.max(F.array_max("weights")), 6).alias("heaviest"))


#: The two lists of the fused queries: by the vectors of documents that have one, and by all documents' terms, both of the
#: query's own tenant. A query is a document with a vector.
HYBRID_SQL = f"""{TERMS_SQL},
v AS (SELECT d.source AS site_id, d.doc_id, e.embedding::DOUBLE[] AS x FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
q AS (SELECT * FROM v WHERE doc_id % {EVERY} = 0),
qw AS (SELECT dw.doc_id AS query_id, dw.site_id, dw.term, dw.w FROM dw JOIN q USING (site_id, doc_id)),
{SCORED_SQL},
dense AS (SELECT q.doc_id AS query_id, v.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_cosine_similarity(q.x, v.x), 6) DESC, v.doc_id) AS rank
  FROM q JOIN v USING (site_id) QUALIFY rank <= 10),
fused AS (SELECT query_id, doc_id, sum(1.0 / (2 + rank - 1)) AS score FROM (SELECT query_id, doc_id, rank FROM sparse UNION ALL SELECT query_id, doc_id, rank FROM dense) GROUP BY 1, 2),
ranked AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused)"""


def hybrid_rows(spark, sf_dir, prefetch=10, limit=20):
    docs = by_tenant(spark, sf_dir, "text")
    packed = packed_of(docs)
    vectors = by_tenant(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    vectors = written(vectors, "vectors")
    asked = vectors.filter(F.col("doc_id") % EVERY == 0)
    by_vector = dense.dense_topk(asked.withColumnRenamed("doc_id", "query_id"), vectors, prefetch, vec_id="doc_id")
    terms = packed.filter(F.col("doc_id") % EVERY == 0).join(asked.select("site_id", "doc_id"), ["site_id", "doc_id"]).withColumnRenamed("doc_id", "query_id")
    by_terms = sparse.blocked_topk(terms, packed, docs.groupBy("site_id").agg(F.count("*").alias("n")), prefetch)
    return fusion.hybrid(by_vector, by_terms, "doc_id", prefetch, limit)


@query(f"WITH {HYBRID_SQL} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 20")
def hybrid_rrf(spark, sf_dir):
    return hybrid_rows(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {HYBRID_SQL} SELECT query_id, doc_id, score FROM ranked ORDER BY score DESC, query_id, doc_id LIMIT 20")
def hybrid_global_cut(spark, sf_dir):
    found = hybrid_rows(spark, sf_dir, limit=1 << 30).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return fusion.best_of(found, 20, ["query_id", "doc_id"])


@query(f"WITH {DENSE_SQL} SELECT query_id, vec_id, round(100 * (1 - abs(1 - score)), 4) AS percent FROM dense")
def redis_percent_score(spark, sf_dir):
    return dense_rows(spark, sf_dir).select("query_id", "vec_id", F.round(V.percent_score(1 - F.col("score")), 4).alias("percent"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-12), 6) + 0.0 AS first FROM embeddings")
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), (F.round(V.normalised(F.col("embedding"))[0], 6) + 0.0).alias("first"))


@query("""WITH e AS (SELECT vec_id, (vec_id + (i - 1) // 8) % 3 > 0 AS m, embedding[i]::DOUBLE AS x, (i - 1) % 8 + 1 AS position FROM embeddings, range(1, 65) r(i))
SELECT vec_id, position, round(sum(CASE WHEN m THEN x ELSE 0 END) / greatest(sum(CASE WHEN m THEN 1.0 ELSE 0 END), 1e-9), 6) + 0.0 AS mean FROM e GROUP BY 1, 2""")
def mean_pool(spark, sf_dir):
    """A vector's eighths as a chunk's token vectors, some of them masked."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("vec_id") + i) % 3 > 0).cast("int"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.mean_pool(tokens, mask)).alias("p", "x"))
    return v.select("vec_id", (F.col("p") + 1).cast("long").alias("position"), (F.round("x", 6) + 0.0).alias("mean"))


@query("""WITH t AS (SELECT vec_id, embedding, embedding[64]::DOUBLE AS d FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * d)), 6) + 0.0 AS weight FROM t""")
def token_weight(spark, sf_dir):
    """A token's weight as its product with another vector: here one of its last element throughout."""
    v = table(spark, sf_dir, "embeddings")
    other = F.transform("embedding", lambda x: F.element_at("embedding", 64))
    return v.select("vec_id", (F.round(V.dot(F.col("embedding"), other), 6) + 0.0).alias("weight"))
