"""Ingest: sentences, chunks, the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import codecs, text
from siftlake.operators import boundaries, chunking, embedding, lists, store
from siftlake.plans.inputs import table
from siftlake.plans.registry import query
from siftlake.plans.scalars import murmur3_sql
from siftlake.sources import queue

SITE = "cast(substr(source, 4) as bigint)"
PATTERN = text.SENTENCE
WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Sentence bounds by document, then the chunks' spans step by step.
SPANS_SQL = f"""pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PATTERN}')) AS p, generate_subscripts(regexp_extract_all(text, '{PATTERN}'), 1) AS i FROM documents),
placed AS (SELECT doc_id, i, p, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p))::BIGINT AS a FROM pieces),
bounds AS (SELECT doc_id, i, a + length(p) - length(ltrim(p, {WHITE})) AS b, a + length(rtrim(p, {WHITE})) AS e FROM placed),
lists AS (SELECT doc_id, list(b ORDER BY i) AS b, list(e ORDER BY i) AS e, count(*)::BIGINT AS n FROM bounds WHERE b < e GROUP BY doc_id)"""


def chunks_sql(size: int, overlap: int) -> str:
    last = lambda s: f"greatest({s} + 1, len(list_filter(e, lambda x: x - b[{s} + 1] <= {size})))"
    back = lambda i: f"(CASE WHEN {i} > 0 AND {i} < n AND e[{i}] - b[{i}] <= {overlap} THEN {i} - 1 ELSE {i} END)"
    return f"""{SPANS_SQL},
walk AS (
  SELECT l.doc_id, n, 0::BIGINT AS i, 0::BIGINT AS s, {last('0')}::BIGINT AS t, b, e FROM lists l JOIN documents d USING (doc_id) WHERE length(d.text) > {size}
  UNION ALL
  SELECT doc_id, n, j, {back('j')}::BIGINT, {last(back('j'))}::BIGINT, b, e
  FROM (SELECT *, CASE WHEN i = 0 THEN t ELSE greatest(t, i + 1) END AS j FROM walk) WHERE j < n),
chunks AS (
  SELECT doc_id, b[s + 1] AS "offset", substr(d.text, b[s + 1] + 1, e[t] - b[s + 1]) AS text FROM walk JOIN documents d USING (doc_id)
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= {size} AND text <> '')"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "source", "text").selectExpr(f"{SITE} as site_id", "doc_id as post_id", "text")


@query(f"WITH RECURSIVE {SPANS_SQL} SELECT doc_id, n AS sentences, b[n] AS last_begin, e[n] AS last_end FROM lists")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.sentences(F.col("text")).alias("p"))
    rows = docs.select("doc_id", F.posexplode("p").alias("i", "p"))
    from pyspark.sql import Window

    before = F.sum(F.char_length("p")).over(Window.partitionBy("doc_id").orderBy("i")) - F.char_length("p")
    bare = lambda pattern: F.char_length(F.regexp_replace("p", pattern, ""))
    spans = rows.select("doc_id", "i", (before + F.char_length("p") - bare(r"^\s+")).alias("b"), (before + bare(r"\s+$")).alias("e")).filter("b < e")
    return spans.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max_by("b", "i").alias("last_begin"), F.max_by("e", "i").alias("last_end"))


@query("SELECT doc_id, length(text) <= 512 AS whole, CASE WHEN length(text) <= 512 THEN 0 ELSE -1 END AS \"offset\" FROM documents WHERE text <> ''")
def chunk_skip_rule(spark, sf_dir):
    """Texts that fit are one chunk at 0."""
    rows = chunking.chunk_documents(table(spark, sf_dir, "documents", "doc_id", "text").withColumn("n", F.char_length("text")))
    return rows.groupBy("doc_id", "n").agg(F.min("offset").alias("o")).select("doc_id", (F.col("n") <= 512).alias("whole"), F.when(F.col("n") <= 512, F.col("o")).otherwise(-1).alias("offset"))


@query(f"WITH RECURSIVE {chunks_sql(512, 128)} SELECT doc_id, \"offset\"::INT AS \"offset\", length(text)::INT AS size, md5(text) AS digest FROM chunks")
def chunk_pack(spark, sf_dir):
    rows = chunking.chunk_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "offset", F.char_length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT count(*) AS documents, 0::BIGINT AS wrong FROM documents WHERE text <> ''")
def chunk_substring_check(spark, sf_dir):
    """Each chunk is the part of its text at its offset."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = chunking.chunk_documents(docs.withColumn("whole", F.col("text")), 1000, 200, lossless=True)
    wrong = F.expr("substring(whole, offset + 1, char_length(text)) <> text")
    return rows.groupBy("doc_id").agg(F.count_if(wrong).alias("w")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("w"), F.lit(0)).alias("wrong"))


def stored(spark, sf_dir):
    """A chunk table of the size limits before a change, and the changed documents' chunks: every third is written anew."""
    docs = documents(spark, sf_dir)
    before = chunking.chunk_documents(docs).select(*store.KEY, F.char_length("text").alias("size"), F.lit(0).alias("version"))
    changed = docs.filter("post_id % 3 = 0").withColumn("text", F.concat(F.lit("New. "), "text"))
    after = chunking.chunk_documents(changed).select(*store.KEY, F.char_length("text").alias("size"), F.lit(1).alias("version"))
    return before, after


def stored_sql(rest: str) -> str:
    old = chunks_sql(512, 128)
    new = old.replace("documents", "newer").replace("pieces", "pieces2").replace("placed", "placed2").replace("bounds", "bounds2").replace("lists", "lists2").replace("walk", "walk2").replace("chunks", "chunks2")
    site = f"(SELECT doc_id, {SITE} AS site_id FROM documents)"
    return f"""WITH RECURSIVE newer AS (SELECT doc_id, 'New. ' || text AS text FROM documents WHERE doc_id % 3 = 0), {old}, {new},
before AS (SELECT site_id, doc_id AS post_id, "offset"::INT AS "offset", length(text)::INT AS size, 0 AS version FROM chunks JOIN {site} USING (doc_id)),
after AS (SELECT site_id, doc_id AS post_id, "offset"::INT AS "offset", length(text)::INT AS size, 1 AS version FROM chunks2 JOIN {site} USING (doc_id))
{rest}"""


@query(stored_sql('SELECT * FROM (SELECT * FROM after QUALIFY row_number() OVER (PARTITION BY site_id, post_id, "offset" ORDER BY size DESC) = 1) UNION ALL SELECT * FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.site_id = b.site_id AND a.post_id = b.post_id AND a."offset" = b."offset")'))
def upsert_chunks(spark, sf_dir):
    return store.upsert(*stored(spark, sf_dir), order="size")


@query(stored_sql('SELECT * FROM (SELECT * FROM after QUALIFY row_number() OVER (PARTITION BY site_id, post_id, "offset" ORDER BY size DESC) = 1) UNION ALL SELECT * FROM before b WHERE post_id % 3 <> 0'))
def replace_document(spark, sf_dir):
    return store.upsert(*stored(spark, sf_dir), order="size", replace_document=True)


@query(stored_sql("SELECT * FROM before WHERE post_id % 3 <> 0"))
def delete_document(spark, sf_dir):
    before, after = stored(spark, sf_dir)
    return store.delete(before, after.select("site_id", "post_id"))


@query(stored_sql('SELECT * FROM before WHERE NOT (post_id % 2 = 0 AND "offset" = 0)'))
def delete_by_offset(spark, sf_dir):
    before, _ = stored(spark, sf_dir)
    return store.delete(before, before.filter("post_id % 2 = 0 and offset = 0").select(*store.KEY))


@query(f"WITH RECURSIVE {chunks_sql(512, 128)} SELECT doc_id AS post_id, to_json(list(\"offset\"::INT ORDER BY \"offset\")) AS offsets FROM chunks GROUP BY doc_id")
def offset_list(spark, sf_dir):
    rows = store.offsets(chunking.chunk_documents(documents(spark, sf_dir)))
    return rows.select("post_id", F.to_json("offsets").cast("string").alias("offsets"))


@query("SELECT doc_id, (doc_id << 32) | n_chars AS point_id FROM documents")
def point_id(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", codecs.point_id(F.col("doc_id"), F.col("n_chars")).alias("point_id"))


@query(r"""WITH t AS (SELECT doc_id, substr(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g'), 1, 100) AS x FROM documents)
SELECT doc_id, CASE WHEN contains(x, ' ') THEN regexp_extract(x, '^(.*) ', 1) ELSE x END AS seen FROM t""")
def lang_prepare(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.detection_text(F.col("text")).alias("seen"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'unk' END)
WHEN (n_chars % 10) / 10.0 >= 0.2 AND lang IN ('en', 'fr', 'de') THEN lang ELSE 'unk' END AS language FROM documents""")
def lang_rule(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    asked = F.when(F.col("doc_id") % 5 > 0, F.col("lang")).otherwise("auto")
    return docs.select("doc_id", text.language_rule(asked, F.col("lang"), F.col("n_chars") % 10 / 10.0, ["en", "fr", "de"]).alias("language"))


E5_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.INSTRUCTIONS.items())


@query(f"""SELECT item_id, 'query: ' || text AS arctic, 'Query: ' || text AS jina, 'Document: ' || text AS jina_store, text AS mpnet,
'Instruct: ' || CASE ['auto', 'en', 'fr', 'de', 'es', 'it', 'ro', 'xx'][item_id % 8 + 1] {E5_SQL} ELSE '{text.INSTRUCTIONS["auto"]}' END || chr(10) || 'Query: ' || text AS e5 FROM benchmark""")
def prefix_by_mode(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    language = F.element_at(F.array(*[F.lit(x) for x in ("auto", "en", "fr", "de", "es", "it", "ro", "xx")]), (F.col("item_id") % 8 + 1).cast("int"))
    of = lambda model, mode: text.model_input(F.col("text"), model, mode, language)
    return b.select("item_id", of("arctic", "search").alias("arctic"), of("jina", "search").alias("jina"), of("jina", "store").alias("jina_store"), of("mpnet", "search").alias("mpnet"), of("e5", "search").alias("e5"))


@query("SELECT doc_id, length(text) > 0 AS valid, strlen(text)::INT AS bytes, CASE WHEN strlen(text) > 5000 THEN 'too long' WHEN text = '' THEN 'empty' ELSE 'ok' END AS verdict FROM documents")
def request_validation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    size = F.octet_length("text")
    return docs.select("doc_id", (F.char_length("text") > 0).alias("valid"), size.alias("bytes"), F.when(size > 5000, "too long").when(F.col("text") == "", "empty").otherwise("ok").alias("verdict"))


@query("SELECT page_id, url, length(html) AS size FROM pages")
def page_projection(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.char_length("html").cast("long").alias("size"))


@query("""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS digest FROM c""".replace("\\\\", "\\"))
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT doc_id, to_json(map {'id': doc_id::VARCHAR, 'language': lang, 'source': source}) AS metadata FROM documents")
def metadata_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    item = F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("language"), F.lit("auto"))
    extra = F.create_map(F.lit("source"), F.col("source"))
    found = lists.merged_metadata(item, F.create_map(F.lit("language"), F.col("lang")), extra)
    pairs = F.map_from_entries(F.array_sort(F.map_entries(found)))
    return docs.select("doc_id", F.to_json(pairs).cast("string").alias("metadata"))


@query("SELECT event_id, event_id::INT AS id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS text FROM events WHERE event_id % 7 > 0")
def store_request_parse(spark, sf_dir):
    """Each event as a request's body of one document; every seventh can't be read or is empty."""
    one = F.to_json(F.array(F.struct(F.col("event_id").cast("int").alias("id"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("text"), F.lit(1).alias("unknown"))))
    body = F.when(F.col("event_id") % 14 == 0, "[]").when(F.col("event_id") % 7 == 0, "{broken").otherwise(one)
    good, _ = queue.store_requests(table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return good.select("event_id", "id", "text")


@query("SELECT event_id, true AS same FROM events")
def payload_binary_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("int").alias("site_id"), F.col("event_id").cast("int").alias("id"), F.col("props").alias("text"), F.create_map(F.lit("k"), F.col("event_type")).alias("extra"),
        F.col("event_id").alias("timestamp_millis"), F.lit(1).alias("retry_count"), F.lit(3).alias("max_retries"), F.lit("FAILED").alias("status"), F.lit("é").alias("error_message"), F.lit(-5).cast("long").alias("last_retry_timestamp"), F.lit("auto").alias("language"),
    )
    back = rows.withColumn("back", queue.from_bytes(queue.to_bytes()))
    text = lambda c: F.to_json(c).cast("string")
    names = list(queue.FIELDS)
    return back.select("event_id", (text(F.struct(*names)) == text(F.struct(*[F.col(f"back.{n}").alias(n) for n in names]))).alias("same"))


HASHED_SQL = f"""words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM documents), kept AS (SELECT * FROM words WHERE term <> ''), {murmur3_sql("kept")},
cells AS (SELECT doc_id, (h % 64)::INT AS position, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS x FROM kept JOIN murmur USING (term) GROUP BY 1, 2)"""


@query(f"WITH {HASHED_SQL} SELECT doc_id, position, round((x::FLOAT / sqrt(sum(x * x) OVER (PARTITION BY doc_id))::FLOAT)::DOUBLE, 5) + 0.0 AS value FROM cells QUALIFY x <> 0")
def hashing_embedding(spark, sf_dir):
    """Whole texts' vectors by the stand-in model: their elements that aren't 0."""
    rows = embedding.embed(table(spark, sf_dir, "documents", "doc_id", "text"), "mpnet", "store").select("doc_id", F.posexplode("dense").alias("position", "x"))
    return rows.filter("x <> 0").select("doc_id", "position", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("value"))


#: The counts behind sentence boundaries, and the ratio by which a word's period is its own.
RUNS_SQL = rf"""every AS (SELECT unnest(regexp_extract_all(text, '{boundaries.RUN}')) AS run FROM documents),
bare AS (SELECT regexp_replace(run, '{boundaries.AROUND}', '', 'g') AS bare FROM every),
types AS (SELECT regexp_replace(lower(bare), '\.$', '') AS type, count(*) AS n, sum((bare LIKE '%.')::INT)::BIGINT AS ended, sum((NOT regexp_matches(bare, '^\p{{Lu}}'))::INT)::BIGINT AS lower FROM bare GROUP BY 1),
lettered AS (SELECT * FROM types WHERE regexp_matches(type, '\p{{L}}')), total AS (SELECT sum(ended) / sum(n)::DOUBLE AS share FROM lettered)"""


@query(rf"""WITH {RUNS_SQL} SELECT type, n, ended, lower, round(2 * (ended * ln(0.99::DOUBLE) + (n - ended) * ln(1 - 0.99::DOUBLE) - ended * ln(share) - (n - ended) * ln(1 - share)), 3) AS ratio FROM lettered, total""")
def period_ratios(spark, sf_dir):
    """How much more likely each word's periods are its own than ends of sentences."""
    found = boundaries.scored(boundaries.type_counts(table(spark, sf_dir, "documents", "text")))
    return found.select("type", "n", "ended", "lower", F.round("ratio", 3).alias("ratio"))
