"""What must not grow with the number of tenants, queries or documents."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake import scratch
from siftlake.functions import text
from siftlake.operators import embedding, sparse
from siftlake.operators import search as search_texts
from siftlake.plans import flows, registry, search
from siftlake.scratch import written
from siftlake.sources import jsonl


def test_an_export_has_few_folders(spark, tmp_path):
    """Many tenants share folders; one tenant's letters are read from its folder alone, and a tenant can be null."""
    rows = spark.range(3000).select(F.col("id").alias("timestamp"), (F.col("id") % 1500).cast("int").alias("site_id"), F.col("id").cast("int").alias("doc_id"))
    path = str(tmp_path / "out")
    jsonl.export_letters(rows.unionByName(rows.limit(1).withColumn("site_id", F.lit(None).cast("int"))), path)
    assert len(list((tmp_path / "out").glob("*=*"))) <= jsonl.BUCKETS + 1
    back = jsonl.read_letters(spark, path)
    assert "bucket" not in back.columns and back.count() == 3001 and back.filter("site_id is null").count() == 1
    one = jsonl.read_letters(spark, path, site_id=7)
    assert sorted(r.doc_id for r in one.collect()) == [7, 1507] and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


@pytest.mark.parametrize(("k", "block"), [(1, 40), (10, 40), (2000, 5000)])
def test_blocks_give_the_rows_of_the_join(spark, k, block):
    """Queries of many terms against blocks of documents; equal scores, unknown terms and tenants, documents without terms."""
    rng = random.Random(k)
    rows = [("s0" if i % 3 else "s1", i % 400 if i % 7 else i, f"t{min(int(rng.expovariate(0.05)), 90)}", 1 + i % 3) for i in range(6000)]
    counts = written(spark.createDataFrame(rows, "site_id string, doc_id long, term string, tf long").groupBy("site_id", "doc_id", "term").agg(F.sum("tf").alias("tf")), "counts")
    keys = ["site_id", "doc_id"]
    postings, packed = sparse.count_weights(counts, keys).withColumnRenamed("weight", "dw"), written(sparse.packed_weights(counts, keys), "packed")
    sizes = counts.groupBy("site_id").agg((F.countDistinct("doc_id") + 5).alias("n"))
    asked = spark.createDataFrame([(q, f"s{q % 3}", f"t{t}", rng.random()) for q in range(30) for t in rng.sample(range(95), 20)], "query_id long, site_id string, term string, qw double")
    queries = asked.groupBy("query_id", "site_id").agg(F.collect_list("term").alias("terms"), F.collect_list("qw").alias("weights"))
    some = lambda df: sorted((r.query_id, r.site_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    found = sparse.blocked_topk(queries, packed, sizes, k, block=block)
    assert some(found) == some(sparse.sparse_topk(asked, postings, sizes, k)) != []


def test_fused_lists_make_no_row_for_a_pair_of_texts(spark, sf):
    """Scores are summed within blocks: Spark gets k rows for a query and a block, and joins no postings with queries."""
    plan = search.hybrid_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "dw#" not in plan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detection_works_once_on_a_texts_head(spark):
    """What detection sees is the same from a text's head; words are cut once for all languages, not for each mention."""
    rng = random.Random(1)
    rows = [("".join(rng.choice(["a", "É", "İ", "Σ", " ", "  ", "\n\t", "\u00a0", "𝒳", "der ", "the "]) for _ in range(rng.choice([0, 3, 60, 150, 2000]))),) for _ in range(300)] + [(None,), (" " * 5000 + "the end " * 90,)]
    docs = spark.createDataFrame(rows, "text string")
    t = F.col("text")
    assert docs.filter(~text.detection_text(text.head(t)).eqNullSafe(text.detection_text(t))).count() == 0
    plan = plan_of(docs.select(text.detected(t).alias("d")).select("d.language", "d.score"))
    assert plan.count("split(") == 1


def test_the_hashing_model_takes_many_texts_and_adds_up_alike(spark):
    """One call hashes many texts; a text's vector doesn't depend on its neighbours, nor on where parts end."""
    texts = ["b a a", "", "  ", "é " * 40, *(f"w{i} w{i % 7} x" for i in range(400)), "word " * 300_000, "a b a"]
    model = embedding.hashing()
    whole = model(texts)
    assert (whole[0] == whole[-1]).all() and not whole[1:3].any()
    assert all((model([t])[0] == v).all() for t, v in zip(texts, whole, strict=True))
    assert embedding.MODELS["mpnet"].batch > embedding.BATCH
    assert [len(x) for _, x in embedding.together(["a" * embedding.TOGETHER] * 3)] == [1, 1, 1] and not list(embedding.together([]))


def test_sparse_vectors_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "b c c the"), (2, None), (3, ""), (4, "the 12"), (5, "ΣΑΣ")], "k int, text string")
    got = {r.k: r.v for r in rows.select("k", embedding.sparse_vector("text").alias("v")).collect()}
    assert sorted(got[1].values()) == pytest.approx([1 / 3, 2 / 3]) and got[2] is None and got[3] == got[4] == {} and list(got[5].values()) == [1.0]


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    """Tasks grow with the texts where they become many rows, and not below the number of shuffles."""
    docs = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    parts = lambda: scratch.dealt(docs, "id", text="text").rdd.getNumPartitions()
    assert parts() == 4
    monkeypatch.setattr(scratch, "PART", 5000)
    assert parts() == 20 and scratch.dealt(docs.limit(0), "id", text="text").count() == 0


def test_tokens_and_grams_are_dealt_before_they_are_cut(spark, sf):
    queries = registry.queries()
    for name in ("unknown_tokens", "sparse_e5"):
        plan = plan_of(queries[name](spark, sf))
        assert "RepartitionByExpression" in plan


def test_pieces_are_cut_once_and_not_shuffled(spark, sf):
    plan = registry.queries()["sparse_arctic"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert not re.search(r"hashpartitioning\(conv_id#\d+L?, turn#\d+L?, \d+\), ENSURE_REQUIREMENTS", plan)


def test_blocks_are_summed_up_in_tasks_of_their_groups(spark, monkeypatch):
    """Postings are dealt by group, to tasks that grow with them, before a block's largest weight is found; nothing is summed up
    for a whole file of postings."""
    postings = spark.range(30_000).select(F.lit("s").alias("site_id"), (F.col("id") % 500).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("term"), (1 / (2 + F.col("id") % 9)).alias("dw"))
    made = {}
    monkeypatch.setattr(sparse, "TASK", 3000)
    monkeypatch.setattr(sparse, "written", lambda df, name: made.setdefault(name, df) is None or written(df, name))
    index = sparse.sparse_index(postings, spark.createDataFrame([("s", 500)], "site_id string, n long"), group=300)
    assert index.tops.agg(F.sum("n")).first()[0] == 30_000
    plan = made["tops"]._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"hashpartitioning\(site_id#\d+, shelf#\d+, part#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= 10
    assert not re.search(r"hashpartitioning\([^)]*term#[^)]*\)", plan)


@pytest.mark.parametrize(("most", "block"), [(5, 300), (128, 1 << 20)])
def test_blocks_give_the_weights_of_counted_terms(spark, most, block):
    """The same terms and weights as by a row for each term; repeated and missing ids, texts without terms, equal weights, many blocks."""
    rng = random.Random(most)
    texts = [" ".join(rng.choice(["the", "x", "É", "été", "漢字", "𝒳𝒳", "b1b", *(f"w{'abcdefghij'[min(int(rng.expovariate(0.4)), 9)]}" for _ in range(9))]) for _ in range(rng.choice([0, 1, 30]))) for _ in range(200)]
    rows = [(f"s{i % 3}" if i % 50 else None, i % 170 if i % 60 else None, t if i % 40 else None) for i, t in enumerate(texts)] + [("lone", 1, "the a x")]
    docs = spark.createDataFrame(rows, "site_id string, doc_id long, text string").repartition(3)
    found = sparse.blocked_bm25(docs, most=most, block=block)
    got = [(r.site_id, r.doc_id, t, w) for r in found.collect() for t, w in zip(r.terms, r.weights, strict=True)]
    want = list(map(tuple, sparse.bm25_weights(sparse.term_counts(docs, ["site_id", "doc_id"]), "site_id", "doc_id", most).collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr) != []
    assert sparse.blocked_bm25(docs.limit(0)).count() == 0


def test_terms_of_documents_are_not_joined(spark, sf):
    """Spark sends a term once for a block and each document as one row."""
    plan = registry.queries()["sparse_bm25"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "tf#" not in plan


def test_halves_are_rounded_as_spark_does(spark):
    x = [1.2345678905, 0.0000000005, 2.5e-9, 3.0000000015, 1 / 3, 7.1234567895, 0.1 + 0.2]
    want = [int(r.d * 10**9) for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9).cast("decimal(18,9)").alias("d")).collect()]
    assert sparse._nines(np.array(x)).tolist() == want


def test_one_worker_makes_both_vectors(spark, sf):
    """Dense and sparse vectors of a text come from one Python worker, so that a task has one and not two."""
    made = flows.whole_chunks(spark, sf)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    odd = spark.createDataFrame([("b c",), (None,), ("",)], "text string")
    got = search_texts.with_vectors(odd, "letters").collect()
    assert [r.error for r in got] == [None] * 3 and got[1].dense is None and got[1].sparse is None and got[2].sparse == {} and len(got[0].dense) == 26
