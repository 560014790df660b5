"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import codecs, text, values
from siftlake.plans.inputs import table
from siftlake.plans.registry import query
from siftlake.scratch import dealt

#: Sizes as text, the way configuration has them.
SIZE = "case p_partkey % 6 when 0 then concat(cast(p_size as varchar(9)), 'K') when 1 then concat(' ', cast(p_size as varchar(9)), '.5m ') when 2 then concat(cast(p_size as varchar(9)), 'G') when 3 then cast(p_size as varchar(9)) when 4 then 'ABC' else '' end"


@query(f"""WITH s AS (SELECT p_partkey, trim({SIZE}) AS t FROM part), x AS (SELECT p_partkey, t, TRY_CAST(regexp_extract(t, '^(\\d+(?:\\.\\d+)?)[KMGTkmgt]?$', 1) AS DOUBLE) AS n, upper(regexp_extract(t, '([KMGTkmgt])$', 1)) AS u FROM s)
SELECT p_partkey, coalesce(floor(n * CASE u WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 ELSE 1 END), 77)::BIGINT AS bytes FROM x""")
def config_bytesize(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{SIZE} as t").select("p_partkey", values.byte_size(F.col("t"), 77).alias("bytes"))


@query("SELECT event_id, CASE WHEN value < 0 OR value > 100 THEN 0.5::DOUBLE WHEN value > 1 THEN value / 100 ELSE value END AS share FROM events")
def config_percentage(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.percentage(F.col("value"), 0.5).alias("share"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS flag FROM nation")
def config_boolean(spark, sf_dir):
    texts = F.element_at(F.array(*[F.lit(x) for x in ("TRUE", "off", " yes ", "0", "maybe")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", values.boolean(texts, True).alias("flag"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 60000 WHEN 2 THEN p_size * 3600000 + 1500 ELSE 9 END::BIGINT AS ms FROM part")
def config_duration(spark, sf_dir):
    kind, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    t = F.when(kind == 0, F.concat(n, F.lit("ms"))).when(kind == 1, F.concat(n, F.lit("m"))).when(kind == 2, F.concat(n, F.lit("h1.5s"))).otherwise(F.concat(n, F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", values.duration_ms(t, 9).alias("ms"))


@query("SELECT p_partkey, coalesce(TRY_CAST(split_part(p_type, ' ', 1) AS BIGINT), 5) AS whole, round(p_retailprice, 2) AS price FROM part")
def config_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", values.integer(F.split_part("p_type", F.lit(" "), F.lit(1)), 5).alias("whole"), F.round(values.real(F.col("p_retailprice").cast("string"), 0.0), 2).alias("price"))


@query("SELECT s_suppkey, 'node' || s_suppkey AS host, (6000 + s_nationkey)::INT AS port, CASE WHEN s_suppkey % 2 = 0 THEN 'master' END AS master FROM supplier")
def address_parse(spark, sf_dir):
    t = F.concat(F.lit("node"), "s_suppkey", F.lit(":"), F.col("s_nationkey") + 6000, F.when(F.col("s_suppkey") % 2 == 0, "/master").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", values.address(t).alias("a")).select("s_suppkey", "a.host", "a.port", "a.master")


@query("SELECT s_suppkey, 'site_' || s_suppkey AS collection, s_suppkey || ':' || s_nationkey || ':0' AS key FROM supplier")
def key_builders(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("site_%d", "s_suppkey").alias("collection"), F.format_string("%d:%d:%d", "s_suppkey", "s_nationkey", F.lit(0)).alias("key"))


@query("SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def sha256_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", codecs.key_hash(F.col("c_name")).alias("hash"))


@query("SELECT o_orderkey, to_base64(unhex(printf('%08x', o_orderkey))) AS wire, o_orderkey AS back FROM orders")
def b64_u32_roundtrip(spark, sf_dir):
    wire = codecs.encode_u32(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", wire.alias("wire"), codecs.decode_u32(wire).alias("back"))


@query("""WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: hex((x::FLOAT::BIT)::BLOB)) AS h FROM embeddings)
SELECT vec_id, md5(to_base64(unhex(array_to_string(h, '')))) AS wire, true AS same,
  md5(array_to_string(list_transform(h, lambda x: x[7:8] || x[5:6] || x[3:4] || x[1:2]), '')) AS bytes FROM h""")
def vector_codec_roundtrip(spark, sf_dir):
    """Big-endian base64, little-endian bytes, and the way back."""
    wire = codecs.encode_vector("embedding")
    v = table(spark, sf_dir, "embeddings").withColumn("wire", wire)
    return v.select("vec_id", F.md5("wire").alias("wire"), (codecs.decode_vector("wire") == F.col("embedding")).alias("same"), F.md5(F.hex(codecs.vector_bytes("embedding"))).alias("bytes"))


def murmur3_sql(rows: str) -> str:
    """term and h, the unsigned 32-bit hash, of the distinct terms of rows: four bytes at a time, the rest, the last mix."""
    mask = "4294967295::UBIGINT"
    turn = lambda x, r: f"(((({x}) << {r}) | (({x}) >> {32 - r})) & {mask})"
    mixed = lambda k: f"({turn(f'(({k}) * 3432918353::UBIGINT) & {mask}', 15)} * 461845907::UBIGINT) & {mask}"
    little = "('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::UBIGINT"
    rest = "('0x0' || CASE WHEN n % 4 > 2 THEN substr(h, 2 * n - 1, 2) ELSE '' END || CASE WHEN n % 4 > 1 THEN substr(h, 2 * (n - n % 4) + 3, 2) ELSE '' END || CASE WHEN n % 4 > 0 THEN substr(h, 2 * (n - n % 4) + 1, 2) ELSE '' END)::UBIGINT"
    return f"""m0 AS (SELECT DISTINCT term, hex(encode(term)) AS h, strlen(term) AS n FROM {rows}),
m1 AS (SELECT term, n, list_transform(list_transform(range(n // 4), lambda i: {little}), lambda k: {mixed('k')}) AS ks, {rest} AS t FROM m0),
m2 AS (SELECT term, n, list_reduce(ks, lambda a, k: ({turn('xor(a, k)', 13)} * 5 + 3864292196::UBIGINT) & {mask}, 0::UBIGINT) AS a, {mixed('t')} AS t FROM m1),
m3 AS (SELECT term, xor(xor(a, t), n::UBIGINT) AS x FROM m2),
m4 AS (SELECT term, (xor(x, x >> 16) * 2246822507::UBIGINT) & {mask} AS x FROM m3),
m5 AS (SELECT term, (xor(x, x >> 13) * 3266489909::UBIGINT) & {mask} AS x FROM m4),
murmur AS (SELECT term, xor(x, x >> 16) AS h FROM m5)"""


@query(f"""WITH words AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS term FROM documents), {murmur3_sql("words")}
SELECT term, abs(CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h::BIGINT END)::BIGINT AS term_id FROM murmur""")
def term_ids(spark, sf_dir):
    """Ids of all lower-case words."""
    words = table(spark, sf_dir, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("term")).distinct()
    return words.select("term", codecs.term_id("term").alias("term_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 256 THEN left(text, 250) || '...' || right(text, 3) ELSE text END AS shown FROM documents")
def log_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.truncated(F.col("text")).alias("shown"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z]+', '_', 'g'), '_') AS plain, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS digits FROM part")
def slugs(spark, sf_dir):
    t = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(t).alias("plain"), text.slug(t, digits=True).alias("digits"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[^A-Z]', '', 'g') AS series, TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS number FROM part")
def code_parse(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.series(F.col("p_brand")).alias("series"), text.number(F.col("p_brand")).alias("number"))


@query("SELECT n_nationkey, 'Dear ' || n_name || ', region ' || n_regionkey AS letter FROM nation")
def template_fill(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.filled(F.lit("Dear {name}, region {region}"), {"name": F.col("n_name"), "region": F.col("n_regionkey").cast("string")}).alias("letter"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(left(n_name, 2)) ELSE lower(left(n_name, 2)) || '_' || upper(right(n_name, 2)) END AS locale FROM nation")
def locale_code(spark, sf_dir):
    code = F.concat(F.left("n_name", F.lit(2)), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.lower(F.right("n_name", F.lit(2))))))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.locale(code).alias("locale"))


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{text.SPACES}')) AS w FROM documents), x AS (SELECT doc_id, regexp_replace(regexp_replace(lower(w), '^[\pM\pP\pS\pZ\pC]+', ''), '[\pM\pP\pS\pZ\pC]+$', '') AS l FROM t WHERE w <> '')
SELECT doc_id, count(*) AS tokens, count(DISTINCT CASE WHEN l = '' THEN '<unk>' ELSE l END) AS lemmas, count(*) FILTER (l = '') AS unknown FROM x GROUP BY 1""")
def unknown_tokens(spark, sf_dir):
    # Texts are dealt before they are cut: neither tokens nor lemmas are shuffled.
    docs = dealt(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", text="text")
    rows = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("w"))
    # Equal tokens of a document are trimmed once.
    lemmas = rows.groupBy("doc_id", "w").agg(F.count("*").alias("n")).withColumn("l", text.lemma(F.col("w")))
    return lemmas.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.count_distinct("l").alias("lemmas"), F.sum(F.when(F.col("l") == "<unk>", F.col("n")).otherwise(0)).alias("unknown"))


@query("SELECT l_linenumber, (500 * pow(2, l_linenumber))::BIGINT AS call_ms, (pow(2, l_linenumber - 1) * 3000 + 1000)::BIGINT AS look_ms, count(*) AS n FROM lineitem GROUP BY 1")
def backoff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return rows.select("l_linenumber", values.retry_delay_ms(F.col("l_linenumber")).alias("call_ms"), values.validation_delay_ms(F.col("l_linenumber"), 3000).alias("look_ms"), "n")


@query("SELECT event_id, event_type = 'error' AND event_id % 2 = 0 AS recoverable FROM events")
def recoverable_errors(spark, sf_dir):
    message = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "model API returned status 500").otherwise("dial tcp: refused")
    return table(spark, sf_dir, "events").select("event_id", values.recoverable(message).alias("recoverable"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def json_codec(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).cast("string").alias("json"))


@query("SELECT user_id, event_id, ts + INTERVAL 720 HOURS AS expires, ts + INTERVAL 720 HOURS < TIMESTAMP '2024-02-10' AS expired, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def expiry(spark, sf_dir):
    until = F.col("ts") + F.expr("interval 720 hours")
    return table(spark, sf_dir, "events").select("user_id", "event_id", until.alias("expires"), (until < F.lit("2024-02-10").cast("timestamp_ntz")).alias("expired"), F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"))
