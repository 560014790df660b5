"""Rows of the admin side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftlake.operators import lists, sparse
from siftlake.plans.inputs import table
from siftlake.plans.registry import query


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}, max(CASE WHEN event_type = '{k}' THEN event_id ELSE -1 END) AS last_{k}" for k in ("click", "error")) + " FROM events GROUP BY 1")
def eav_pivot(spark, sf_dir):
    wide = lists.attributes(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ["click", "error"])
    return wide.select("user_id", *[x for k in ("click", "error") for x in (F.size(F.coalesce(k, F.array().cast("array<bigint>"))).cast("long").alias(f"n_{k}"), F.coalesce(F.array_max(k), F.lit(-1)).alias(f"last_{k}"))])


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS position FROM customer")
def list_sort(spark, sf_dir):
    return lists.sort_list(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id"), "c_mktsegment").select(F.col("id").alias("c_custkey"), "position")


@query("SELECT p_name AS msgid, to_json(list(ref ORDER BY ref)) AS refs FROM (SELECT p_name, 'brand' || p_brand || '.php:' || p_partkey AS ref FROM part) GROUP BY 1")
def msgid_refs(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.concat(F.lit("brand"), "p_brand", F.lit(".php")).alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lit("echo _('"), "p_name", F.lit("');")).alias("text"))
    return lists.message_references(lines).select("msgid", F.to_json("refs").cast("string").alias("refs"))


@query("SELECT r_name AS slug, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def menu_tree(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("slug"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("ord"), F.col("r_regionkey").alias("k"))
    nations = table(spark, sf_dir, "nation").join(regions.select("k", F.col("slug").alias("parent")), F.col("n_regionkey") == F.col("k")).select(F.col("n_name").alias("slug"), "parent", F.col("n_nationkey").alias("ord"))
    tree = lists.children(regions.drop("k").unionByName(nations)).join(regions.select("slug"), "slug", "left_semi")
    return tree.select("slug", F.array_join("children", ",").alias("children"))


@query("SELECT p_name AS msgid, max(CASE WHEN p_brand = 'Brand#1' THEN p_type END) AS en, max(CASE WHEN p_brand = 'Brand#2' THEN p_type END) AS fr FROM part GROUP BY 1")
def translation_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("msgid"), F.when(F.col("p_brand") == "Brand#1", "en").when(F.col("p_brand") == "Brand#2", "fr").alias("locale"), F.col("p_type").alias("text"))
    return lists.translations(rows, ["en", "fr"])


@query("WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey AS directory, o_orderkey AS name FROM f WHERE n > 5")
def file_retention(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("directory"), F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("mtime"))
    return lists.oldest_beyond(files, 5).select("directory", "name")


@query("SELECT event_id, to_json(map {'Accept': event_type}) AS headers FROM events")
def log_redact(spark, sf_dir):
    heads = F.create_map(F.lit("Accept"), F.col("event_type"), F.lit("Authorization"), F.lit("secret"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(lists.redacted(heads)).cast("string").alias("headers"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS word, count(*)::DOUBLE AS weight FROM conversations GROUP BY conv_id")
def subword_merge(spark, sf_dir):
    """A conversation's roles as pieces of one word: the first is marked, the others continue it."""
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").withColumn("t", F.concat(F.when(first, "▁").otherwise(">"), "role"))
    pieces = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("p"))
    merged = pieces.select("conv_id", F.explode(lists.subword_merge(F.concat(F.array(F.lit("<s>")), F.col("p.t")), F.transform(F.sequence(F.lit(0), F.size("p")), lambda _: F.lit(1.0)))).alias("w"))
    return merged.select("conv_id", "w.word", "w.weight")


@query("SELECT event_type, user_id % 7 AS bucket, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def hash_collision(spark, sf_dir):
    """Terms of a row that share an id: the last one stays."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("bucket"), "event_id")
    return sparse.last_of_equal(rows, ["event_type"], "event_id", "bucket")


@query("SELECT count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last, count(*) = 0 AS is_empty FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def list_summary(spark, sf_dir):
    from siftlake.operators.store import matching

    rows = matching(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3)
    return rows.agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"), (F.count("*") == 0).alias("is_empty"))


@query("SELECT user_id, to_json(list(b ORDER BY b)) AS indices, to_json(list(n ORDER BY b)) AS counts FROM (SELECT user_id, event_id % 10 AS b, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def sparse_index_sort(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 10).alias("b")).agg(F.count("*").alias("n"))
    vectors = counted.groupBy("user_id").agg(sparse.sorted_vector(F.map_from_entries(F.collect_list(F.struct("b", "n")))).alias("v"))
    return vectors.select("user_id", F.to_json("v.indices").cast("string").alias("indices"), F.to_json("v.values").cast("string").alias("counts"))


@query("SELECT o_custkey, to_json(list_filter(list(o_orderkey ORDER BY o_orderkey), lambda x: x <> min(o_orderkey))) AS left_over FROM orders GROUP BY 1")
def offset_remove(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"), F.min("o_orderkey").alias("m"))
    return rows.select("o_custkey", F.to_json(lists.removed_first(F.col("o"), F.col("m"))).cast("string").alias("left_over"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS language FROM documents")
def language_names(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "lang").select("doc_id", lists.named(F.col("lang"), {"en": "English", "de": "German"}).alias("language"))
