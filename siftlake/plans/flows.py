"""Operators joined into whole flows, and what goes through files: search from text on, ingest, letters, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlake.functions import codecs, text
from siftlake.operators import catalog, chunking, embedding, profiles, search, store
from siftlake.plans.ingest import SITE, chunks_sql, documents
from siftlake.plans.inputs import LETTERS_SQL, letters, table
from siftlake.plans.registry import query
from siftlake.plans.search import STOP, TERMS, TERMS_SQL, by_tenant
from siftlake.schemas import INDEX_NODES, PAYLOAD
from siftlake.scratch import scratch_folder
from siftlake.sources import jsonl, keyspace, messages, queue
from siftlake.streaming import ingest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vector(column: str) -> str:
    """The `letters` model in SQL: counts as a vector of length 1, elements rounded to floats."""
    counts = f"list_transform(string_split('{' '.join(LETTERS)}', ' '), lambda c: length(lower({column})) - length(replace(lower({column}), c, '')))"
    return f"list_transform({counts}, lambda x: (x / greatest(sqrt(list_sum(list_transform({counts}, lambda y: y * y))), 1e-300))::FLOAT::DOUBLE)"


LANGUAGE_SQL = f"""seen AS (SELECT doc_id, CASE WHEN contains(x, ' ') THEN regexp_extract(x, '^(.*) ', 1) ELSE x END AS t
  FROM (SELECT doc_id, substr(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g'), 1, {text.DETECTED}) AS x FROM documents)),
common AS (SELECT * FROM (VALUES {", ".join(f"('{k}', string_split('{v}', ' '))" for k, v in text.COMMON.items())}) AS l(name, own)),
hits AS (SELECT doc_id, name, len(list_filter(regexp_split_to_array(t, '[^\\pL]+'), lambda w: list_contains(own, w))) AS n FROM seen, common),
language AS (SELECT doc_id, CASE WHEN sum(n) > 0 THEN first(name ORDER BY n DESC, name) END AS language, CASE WHEN sum(n) > 0 THEN max(n) / sum(n) ELSE 0 END AS score FROM hits GROUP BY doc_id)"""


@query(f"WITH {LANGUAGE_SQL} SELECT doc_id, language, round(score, 9) AS score FROM language")
def lang_detect(spark, sf_dir):
    found = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("d", text.detected(F.col("text")))
    return found.select("doc_id", "d.language", F.round("d.score", 9).alias("score"))


def ranks_sql(name: str, key: str, rows: str, top: int) -> str:
    """name (key, gram, rank) of rows (key, text)."""
    return f"""{name}_words AS (SELECT {key}, '_' || word || '_' AS word, count(*) AS n FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}]+')) AS word FROM {rows}) WHERE word <> '' GROUP BY ALL),
{name}_grams AS (SELECT {key}, substr(word, i, k) AS gram, sum(n) AS n FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM {name}_words), range(1, {profiles.LONGEST + 1}) r(k) WHERE i + k - 1 <= length(word) GROUP BY ALL),
{name} AS (SELECT {key}, gram, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, gram) AS rank FROM {name}_grams WHERE gram <> '_' QUALIFY rank <= {top})"""


@query(f"""WITH {LANGUAGE_SQL}, taught AS (SELECT lang AS language, text FROM documents WHERE lang IS NOT NULL AND doc_id % 4 <> 2), short AS (SELECT doc_id, t AS text FROM seen),
{ranks_sql("profile", "language", "taught", profiles.TOP)},
{ranks_sql("own", "doc_id", "short", profiles.SEEN)}, size AS (SELECT doc_id, count(*) AS size FROM own GROUP BY 1),
sums AS (SELECT doc_id, p.language, max(size) * {profiles.TOP} + sum(abs(own.rank - p.rank) - {profiles.TOP}) AS distance FROM own JOIN profile p USING (gram) JOIN size USING (doc_id) GROUP BY ALL),
best AS (SELECT doc_id, arg_min(language, (distance, language)) AS language, min(distance)::BIGINT AS distance FROM sums GROUP BY 1)
SELECT doc_id, best.language, distance FROM documents LEFT JOIN best USING (doc_id)""")
def language_profiles(spark, sf_dir):
    """The language of each document by its first characters, with profiles of three quarters of the documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    known = profiles.learned(docs.filter("doc_id % 4 <> 2"))
    return profiles.languages(docs, ["doc_id"], known)


def whole_chunks(spark, sf_dir):
    """Every document as one stored chunk with both vectors, its source as the tenant."""
    return search.with_vectors(by_tenant(spark, sf_dir, "text").withColumn("point_id", codecs.point_id(F.col("doc_id"), F.lit(0))), "letters")


@query(f"""WITH {TERMS_SQL},
q AS (SELECT b.item_id AS query_id, d.source AS site_id, b.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
qt AS (SELECT query_id, site_id, term, count(*) AS tf FROM (SELECT query_id, site_id, {TERMS} FROM q) WHERE term NOT IN {STOP} GROUP BY ALL),
qw AS (SELECT query_id, site_id, term, (tf * 1.0 / sum(tf) OVER (PARTITION BY query_id))::FLOAT AS w FROM qt),
sparse AS (SELECT query_id, dw.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(qw.w::DOUBLE * ln((n - df + 0.5) / (df + 0.5) + 1) * dw.w::FLOAT::DOUBLE), 9) DESC, dw.doc_id) AS rank
  FROM qw JOIN dw USING (site_id, term) JOIN df USING (site_id, term) JOIN n USING (site_id) GROUP BY 1, 2 QUALIFY rank <= 20),
dv AS (SELECT source AS site_id, doc_id, {letter_vector('text')} AS x FROM documents), qv AS (SELECT query_id, site_id, {letter_vector('text')} AS x FROM q),
dense AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv.x, dv.x) / greatest(sqrt(list_dot_product(qv.x, qv.x)) * sqrt(list_dot_product(dv.x, dv.x)), 1e-300), 6) DESC, doc_id) AS rank
  FROM qv JOIN dv USING (site_id) QUALIFY rank <= 20),
fused AS (SELECT query_id, doc_id, sum(1.0 / (2 + rank - 1)) AS score FROM (SELECT * FROM sparse UNION ALL SELECT * FROM dense) GROUP BY 1, 2)
SELECT query_id, doc_id << 32 AS point_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused QUALIFY rank <= 20""")
def search_end_to_end(spark, sf_dir):
    """Benchmark items asked at the tenant of the document with their number, from text to fused results."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = asked.join(by_tenant(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id").withColumn("language", F.lit("auto"))
    chunks = search.stored(whole_chunks(spark, sf_dir).select("site_id", "point_id", "dense", "sparse"))
    return search.search(asked, chunks, "letters", limit=20, size=0).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH RECURSIVE {chunks_sql(512, 128)}, {LANGUAGE_SQL},
terms AS (SELECT doc_id, "offset", count(DISTINCT term) AS n FROM (SELECT doc_id, "offset", {TERMS} FROM chunks) WHERE term NOT IN {STOP} GROUP BY 1, 2)
SELECT doc_id AS post_id, "offset"::INT AS "offset", CASE WHEN score >= 0.2 THEN language ELSE 'unk' END AS language, coalesce(terms.n, 0)::INT AS terms,
  round(({letter_vector('chunks.text')})[5], 6) + 0.0 AS e, (doc_id << 32) | "offset" AS point_id
FROM chunks JOIN language USING (doc_id) LEFT JOIN terms USING (doc_id, "offset") JOIN documents USING (doc_id) WHERE {SITE} % 3 > 0""")
def ingest_chunks(spark, sf_dir):
    """Documents as queue messages through one batch of the ingest stream; every third tenant is not active."""
    docs = documents(spark, sf_dir)
    sites = docs.select("site_id").distinct().select("site_id", F.when(F.col("site_id") % 3 > 0, "active").otherwise("revoked").alias("status"), F.lit(512).alias("chunk_size"), F.lit(128).alias("chunk_overlap"))
    raw = docs.select(F.to_json(F.struct(F.col("site_id").cast("int").alias("site_id"), F.col("post_id").cast("int").alias("id"), "text")).alias("value"))
    chunks = ingest.step(raw, sites, F.lit(0).cast("long"), "letters")["chunks"]
    return chunks.select(F.col("post_id").cast("long").alias("post_id"), "offset", "language", F.size("sparse").alias("terms"), (F.round(F.col("dense")[4].cast("double"), 6) + 0.0).alias("e"), "point_id")


@query(f"SELECT doc_id AS id, 'FAILED' AS status, 1 AS retry_count, 'unknown or inactive site' AS error_message FROM documents WHERE {SITE} % 3 = 0 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 'DEAD_LETTER', 3, 'unknown or inactive site' FROM documents WHERE {SITE} % 3 = 0 AND doc_id % 2 = 1")
def ingest_failures(spark, sf_dir):
    """Messages of tenants that aren't active: to be sent again, or dead letters after their third attempt."""
    docs = documents(spark, sf_dir)
    sites = docs.select("site_id").distinct().filter("site_id % 3 > 0").select("site_id", F.lit("active").alias("status"), F.lit(512).alias("chunk_size"), F.lit(128).alias("chunk_overlap"))
    raw = docs.select(F.to_json(F.struct(F.col("site_id").cast("int").alias("site_id"), F.col("post_id").cast("int").alias("id"), "text", (F.col("post_id") % 2 * 2).cast("int").alias("retry_count"))).alias("value"))
    out = ingest.step(raw, sites, F.lit(0).cast("long"), "letters")
    return out["retry"].unionByName(out["dead"]).select(F.col("id").cast("long").alias("id"), "status", "retry_count", "error_message")


@query(f"WITH RECURSIVE {chunks_sql(512, 128)} SELECT doc_id, \"offset\"::INT AS \"offset\", length(text)::INT AS size FROM chunks")
def chunk_text_sql(spark, sf_dir):
    """Chunks by the table function."""
    chunking.register(spark)
    table(spark, sf_dir, "documents", "doc_id", "text").createOrReplaceTempView("siftlake_documents")
    return spark.sql("SELECT doc_id, c.offset, char_length(c.chunk) AS size FROM siftlake_documents d, LATERAL chunk_text(d.text, 512, 128) c")


@query(f"WITH {LETTERS_SQL} SELECT site_id, event_id, payload FROM letters WHERE site_id % 5 > 0")
def dlq_delete_tenant(spark, sf_dir):
    """Letters without those of deleted tenants."""
    rows = letters(spark, sf_dir)
    return store.delete(rows, rows.filter("site_id % 5 = 0").select("site_id")).select("site_id", "event_id", "payload")


@query(f"WITH {LETTERS_SQL} SELECT site_id::INT AS site_id, event_id::INT AS doc_id, status AS error_message, retry_count FROM letters")
def dlq_export_read(spark, sf_dir):
    """Letters written as JSON lines, a folder a bucket of tenants, and read back."""
    rows = letters(spark, sf_dir).select(F.col("event_id").alias("timestamp"), F.col("site_id").cast("int").alias("site_id"), F.col("event_id").cast("int").alias("doc_id"), F.col("status").alias("error_message"), "retry_count")
    path = fresh(spark, "letters")
    jsonl.export_letters(rows, path)
    return jsonl.read_letters(spark, path).select("site_id", "doc_id", "error_message", "retry_count")


def fresh(spark, name):
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("""SELECT 'k' || event_id AS key, ['string', 'list', 'set', 'hash', 'zset'][event_id % 5 + 1] AS kind, CASE event_id % 5 WHEN 0 THEN 'v "' || event_type || '"'
WHEN 1 THEN to_json([event_type, 'a'])::VARCHAR WHEN 2 THEN to_json(list_sort([event_type, 'a']))::VARCHAR WHEN 3 THEN '{"user":"' || user_id || '"}' ELSE '{"' || event_type || '":' || (event_id % 7) || '.5}' END AS value FROM events""")
def keyspace_roundtrip(spark, sf_dir):
    """Events as entries of all kinds, dumped and read back."""
    kind = F.col("event_id") % 5
    entries = table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), "event_id").alias("key"), F.element_at(F.array(*map(F.lit, ("string", "list", "set", "hash", "zset"))), (kind + 1).cast("int")).alias("kind"),
        F.when(kind == 0, F.concat(F.lit('v "'), "event_type", F.lit('"'))).alias("text"), F.when(kind.isin(1, 2), F.array("event_type", F.lit("a"))).alias("items"),
        F.when(kind == 3, F.create_map(F.lit("user"), F.col("user_id").cast("string"))).alias("fields"), F.when(kind == 4, F.create_map("event_type", F.col("event_id") % 7 + F.lit(0.5).cast("double"))).alias("scores"),
    )
    path = fresh(spark, "keyspace")
    keyspace.dump(entries, path)
    text = lambda c: F.to_json(c).cast("string")
    return keyspace.rows(spark, path).select("key", "kind", F.coalesce("text", text("items"), text("fields"), text("scores")).alias("value"))


@query("SELECT p_partkey, to_json(list_transform(list_filter(string_split(p_name, ' '), lambda w, i: i > 1 AND i < 4), lambda w: 'Ġ' || w)) AS kept FROM part")
def content_tokens(spark, sf_dir):
    """A prompt's prefix and the padding taken off: of a name's words the second and the third."""
    words = F.split("p_name", " ")
    tokens = F.concat(F.array(F.element_at(words, 1)), F.transform(F.slice(words, 2, 2), lambda w: F.concat(F.lit("Ġ"), w)), F.array(F.lit("<pad>"), F.lit("Ġx")))
    found = embedding.content_tokens(tokens, F.transform(tokens, lambda _: F.lit(1.0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.transform(found, lambda x: x["token"])).alias("kept"))


@query("SELECT o_orderkey, (((o_orderkey * o_orderkey) % 1000003) * o_orderkey) % 1000003 AS id FROM orders")
def power_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codecs.power_id("o_orderkey", F.lit(3), F.lit(1000003)).alias("id"))


@query("SELECT p_partkey, p_name AS name, p_size::VARCHAR AS version FROM part")
def file_headers(spark, sf_dir):
    """`key: value` lines of a comment; the last of equal keys stays."""
    comment = F.concat(F.lit("/*\n * Name: first\n * Name: "), "p_name", F.lit("\n * Version: "), F.col("p_size").cast("string"), F.lit("\n */"))
    found = text.headers(comment)
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(found, "name").alias("name"), F.element_at(found, "version").alias("version"))


@query("SELECT n_name AS msgid, CASE WHEN n_nationkey % 2 = 0 THEN 'one of ' ELSE 'only ' END || n_name AS msgstr, CASE WHEN n_nationkey % 2 = 0 THEN n_name || 's' END AS plural, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END AS forms FROM nation")
def po_plurals(spark, sf_dir):
    """A translation file with plural forms, written and read."""
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.col("n_name")
    plural = q('msgid "', name, '"\nmsgid_plural "', name, 's"\nmsgstr[0] "one "\n"of ', name, '"\nmsgstr[1] "many"\n')
    path = fresh(spark, "po")
    table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, plural).otherwise(q('msgid "', name, '"\nmsgstr "only ', name, '"\n'))).coalesce(1).write.text(path)
    return messages.po_entries(messages.source_lines(spark, path, "*.txt")).select("msgid", "msgstr", "plural", F.size("forms").alias("forms"))


@query("SELECT s_suppkey::INT AS id, s_name AS node_name, NULL::VARCHAR AS node_type, round(s_acctbal)::BIGINT AS max_capacity_bytes FROM supplier")
def schema_alter(spark, sf_dir):
    """A table brought to a new schema: a column added, one renamed away, types changed."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("node_name"), "s_nationkey", F.round("s_acctbal").alias("max_capacity_bytes"))
    return catalog.altered(rows, StructType([f for f in INDEX_NODES if f.name in ("id", "node_name", "node_type", "max_capacity_bytes")]))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE to_base64('\\xFF\\xFE'::BLOB || encode(p_name)) END AS shown FROM part")
def decoded_bytes(spark, sf_dir):
    """UTF-8 as text, other bytes as base64."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.encode("p_name", "utf-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("p_name", "utf-8")))
    return table(spark, sf_dir, "part").select("p_partkey", text.decoded(raw).alias("shown"))


@query("SELECT event_id, user_id::INT AS site_id, event_type AS text, (event_id % 4)::INT AS retry_count FROM events")
def queue_file_roundtrip(spark, sf_dir):
    """Messages published to a folder and read back."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("site_id"), F.col("event_id").cast("int").alias("id"), F.col("event_type").alias("text"), (F.col("event_id") % 4).cast("int").alias("retry_count"))
    path = fresh(spark, "queue")
    queue.publish(rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PAYLOAD]), path)
    back = spark.read.text(path).select(F.from_json("value", "site_id int, id int, text string, retry_count int").alias("m")).select("m.*")
    return back.select(F.col("id").cast("long").alias("event_id"), "site_id", "text", "retry_count")
