"""Tenants, nodes and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import values
from siftlake.operators import capacity, catalog
from siftlake.plans.inputs import NODES_SQL, REQUESTS_SQL, SITES_SQL, nodes, requests, sites, table
from siftlake.plans.registry import query

NOW = 400
VALID = f"status = 'active' AND (expires_day IS NULL OR expires_day > {NOW})"


def valid():
    return catalog.valid_key(F.lit(NOW))


def with_expiry(spark, sf_dir):
    return sites(spark, sf_dir).withColumnRenamed("expires_day", "expires_at")


@query(f"WITH {SITES_SQL} SELECT site_id, domain FROM sites WHERE {VALID}")
def active_key_filter(spark, sf_dir):
    return with_expiry(spark, sf_dir).filter(valid()).select("site_id", "domain")


@query(f"WITH {SITES_SQL} SELECT validation_status, count(*) AS n, min(validation_token) AS first_token FROM sites WHERE path = '/' GROUP BY 1")
def token_lookup(spark, sf_dir):
    return sites(spark, sf_dir).filter("path = '/'").groupBy("validation_status").agg(F.count("*").alias("n"), F.min("validation_token").alias("first_token"))


@query(f"""WITH {SITES_SQL}, {REQUESTS_SQL} SELECT r.request_id, coalesce(s.site_id, -1) AS known FROM requests r LEFT JOIN (SELECT * FROM sites WHERE {VALID}) s ON r.site_id = s.site_id""")
def enrich_left_join(spark, sf_dir):
    """Requests with the valid tenant of their key's hash."""
    keyed = with_expiry(spark, sf_dir).withColumn("api_key", F.sha2(F.col("site_id").cast("string"), 256))
    asked = requests(spark, sf_dir).select("request_id", F.col("site_id").cast("string").alias("key"))
    return catalog.with_site(asked, keyed, F.lit(NOW)).select("request_id", F.coalesce("site_id", F.lit(-1)).alias("known"))


@query(f"""WITH {SITES_SQL}, r AS (SELECT domain, path, 'new' || site_id AS token, 7::BIGINT AS estimated_pages FROM sites WHERE site_id % 4 = 0
  UNION ALL SELECT 'added' || s_suppkey || '.example.com', '/', 'new' || s_suppkey, 9::BIGINT FROM supplier)
SELECT domain, path, coalesce(s.status, 'suspended') AS status, CASE WHEN r.token IS NOT NULL THEN 'pending' ELSE s.validation_status END AS validation_status,
 coalesce(r.token, s.validation_token) AS validation_token, CASE WHEN r.token IS NOT NULL THEN 'http' ELSE 'dns' END AS validation_method, coalesce(s.estimated_pages, r.estimated_pages) AS estimated_pages
FROM sites s FULL JOIN r USING (domain, path)""")
def site_upsert(spark, sf_dir):
    have = sites(spark, sf_dir).withColumn("validation_method", F.lit("dns"))
    known = have.filter("site_id % 4 = 0").select("domain", "path", F.concat(F.lit("new"), "site_id").alias("token"), F.lit(7).cast("long").alias("estimated_pages"))
    added = table(spark, sf_dir, "supplier").select(F.concat(F.lit("added"), "s_suppkey", F.lit(".example.com")).alias("domain"), F.lit("/").alias("path"), F.concat(F.lit("new"), "s_suppkey").alias("token"), F.lit(9).cast("long").alias("estimated_pages"))
    return catalog.register(have, known.unionByName(added))


@query(f"""WITH {SITES_SQL}, e AS (SELECT *, CASE site_id % 5 WHEN 0 THEN 'verify' WHEN 1 THEN 'fail' WHEN 2 THEN 'reset' WHEN 3 THEN 'activate' END AS event, CASE WHEN site_id % 11 = 0 THEN 'wrong' ELSE validation_token END AS token FROM sites),
o AS (SELECT *, coalesce(CASE WHEN event IN ('verify', 'fail') THEN token = validation_token AND validation_status IN ('pending', 'failed') WHEN event = 'reset' THEN validation_status = 'failed' WHEN event = 'activate' THEN validation_status = 'verified' END, false) AS changed FROM e)
SELECT site_id, changed, CASE WHEN NOT changed THEN validation_status WHEN event = 'verify' THEN 'verified' WHEN event = 'fail' THEN 'failed' WHEN event = 'reset' THEN 'pending' ELSE validation_status END AS validation_status,
 CASE WHEN changed AND event = 'activate' THEN 'active' ELSE status END AS status FROM o""")
def state_transition(spark, sf_dir):
    rows = sites(spark, sf_dir).withColumn("expires_at", F.lit(None).cast("timestamp"))
    kind = F.col("site_id") % 5
    event = F.when(kind == 0, "verify").when(kind == 1, "fail").when(kind == 2, "reset").when(kind == 3, "activate")
    token = F.when(F.col("site_id") % 11 == 0, "wrong").otherwise(F.col("validation_token"))
    return catalog.transition(rows, event, token, F.lit("2024-01-01").cast("timestamp")).select("site_id", "changed", "validation_status", "status")


@query("""SELECT o_custkey AS site_id, CASE WHEN max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'verified' WHEN sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) >= 3 THEN 'failed' ELSE 'pending' END AS outcome FROM orders GROUP BY 1""")
def validation_outcome(spark, sf_dir):
    tries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), (F.col("o_orderstatus") == "F").alias("ok"))
    return catalog.validation_outcome(tries, ["site_id"], 3)


SHARES = " + ".join(f"0.5::DOUBLE * (exp(-0.5::DOUBLE * {x} * {x}) + exp(-0.5::DOUBLE * {x + 1} * {x + 1})) / sqrt(2 * pi())" for x in range(-3, 3))
MEMORY = " + ".join(f"0.5::DOUBLE * (exp(-0.5::DOUBLE * {x} * {x}) + exp(-0.5::DOUBLE * {x + 1} * {x + 1})) / sqrt(2 * pi()) * estimated_pages * greatest(0, average_page_size + {x + 0.5}::DOUBLE * st_dev_page_size)" for x in range(-3, 3))


@query(f"WITH {SITES_SQL} SELECT site_id, CASE WHEN estimated_pages <= 0 THEN 0 ELSE floor(3.0::DOUBLE * ({MEMORY}) * (0.9973::DOUBLE / ({SHARES})) / 1000)::BIGINT END AS kilobytes FROM sites")
def memory_estimate(spark, sf_dir):
    """In whole thousands of bytes, which the order of floating-point sums doesn't touch."""
    need = values.memory_estimate(F.col("estimated_pages"), F.col("average_page_size"), F.col("st_dev_page_size"))
    return sites(spark, sf_dir).select("site_id", F.floor(need / 1000).alias("kilobytes"))


@query(f"""WITH {NODES_SQL}, {REQUESTS_SQL}, f AS (SELECT node_type, node_id, max_bytes - greatest(used_bytes, assigned_bytes) AS free FROM nodes WHERE status = 'active'),
m AS (SELECT r.request_id, f.node_id, row_number() OVER (PARTITION BY r.request_id ORDER BY free, f.node_id) AS n FROM requests r JOIN f ON r.node_type = f.node_type AND free >= bytes WHERE bytes BETWEEN 1 AND 1000000000)
SELECT r.request_id, r.node_type, r.bytes, coalesce(m.node_id, -1) AS node_id, CASE WHEN m.node_id IS NULL THEN 'rejected' ELSE 'assigned' END AS status FROM requests r LEFT JOIN m ON r.request_id = m.request_id AND n = 1""")
def best_fit_node(spark, sf_dir):
    return catalog.best_fit(requests(spark, sf_dir), nodes(spark, sf_dir)).withColumn("node_id", F.coalesce("node_id", F.lit(-1)))


def assigned_sql(requests: str) -> str:
    """assigned (request_id, node_type, bytes, node_id): a list of a type's nodes, sorted by free space, goes from request to request."""
    return f"""numbered AS MATERIALIZED (SELECT request_id, node_type, bytes, row_number() OVER (PARTITION BY node_type ORDER BY request_id) AS i FROM {requests}),
lists AS (SELECT node_type, list_sort(list({{'f': max_bytes - greatest(used_bytes, assigned_bytes), 'id': node_id, 'm': max_bytes, 'u': used_bytes, 'a': assigned_bytes}})) AS free FROM nodes WHERE status = 'active' GROUP BY 1),
turn AS (
  SELECT node_type, 0::BIGINT AS i, NULL::BIGINT AS request_id, NULL::BIGINT AS bytes, NULL::BIGINT AS node_id, free FROM lists
  UNION ALL
  SELECT node_type, i, request_id, bytes, node_id, CASE WHEN node_id IS NULL THEN free ELSE list_sort(list_transform(free, lambda x: CASE WHEN x.id = node_id THEN {{'f': x.m - greatest(x.u, x.a + bytes), 'id': x.id, 'm': x.m, 'u': x.u, 'a': x.a + bytes}} ELSE x END)) END
  FROM (SELECT t.node_type, n.i, n.request_id, n.bytes, t.free, CASE WHEN n.bytes BETWEEN 1 AND 1000000000 THEN list_filter(t.free, lambda x: x.f >= n.bytes)[1].id END AS node_id FROM turn t JOIN numbered n ON n.node_type = t.node_type AND n.i = t.i + 1)),
assigned AS (SELECT request_id, node_type, bytes, node_id FROM turn WHERE i > 0)"""


@query(f"""WITH RECURSIVE {NODES_SQL}, {REQUESTS_SQL}, {assigned_sql("requests")}
SELECT request_id, node_type, bytes, coalesce(node_id, -1) AS node_id, CASE WHEN node_id IS NULL THEN 'rejected' ELSE 'assigned' END AS status FROM assigned""")
def assign_in_order(spark, sf_dir):
    """One request after the other, each choice after the earlier ones."""
    return capacity.assign_in_order(requests(spark, sf_dir), nodes(spark, sf_dir)).withColumn("node_id", F.coalesce("node_id", F.lit(-1)))


#: A fifth of the sites have a node already; verified ones activate.
HAS_NODE = "case when site_id % 5 = 0 then site_id % 10 + 1 end"


@query(f"""WITH RECURSIVE {NODES_SQL}, {SITES_SQL}, s AS (SELECT *, {HAS_NODE} AS indexing_node, (estimated_pages * average_page_size)::BIGINT AS need FROM sites),
asks AS (SELECT site_id AS request_id, node_type, need AS bytes FROM s WHERE validation_status = 'verified' AND indexing_node IS NULL), {assigned_sql("asks")}
SELECT s.site_id, coalesce(s.indexing_node, a.node_id, -1) AS indexing_node, CASE WHEN validation_status <> 'verified' THEN 'none' WHEN s.indexing_node IS NOT NULL THEN 'kept' WHEN a.node_id IS NULL THEN 'rejected' ELSE 'assigned' END AS request
FROM s LEFT JOIN assigned a ON a.request_id = s.site_id""")
def activation_assign(spark, sf_dir):
    """Activated sites ask for space, but for those that have a node."""
    rows = sites(spark, sf_dir).withColumn("indexing_node", F.expr(HAS_NODE).cast("long"))
    out = capacity.activated(rows, nodes(spark, sf_dir), F.col("validation_status") == "verified", F.col("estimated_pages") * F.col("average_page_size"))
    return out.select("site_id", F.coalesce("indexing_node", F.lit(-1)).alias("indexing_node"), F.coalesce("request", F.lit("none")).alias("request"))


@query(f"WITH {REQUESTS_SQL} SELECT request_id, bytes, bytes BETWEEN 1 AND 2000000 AS in_range FROM requests")
def memory_gate(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", "bytes", F.col("bytes").between(1, 2_000_000).alias("in_range"))


@query(f"WITH {NODES_SQL} SELECT node_id, max_bytes - greatest(used_bytes, assigned_bytes) AS free FROM nodes")
def free_capacity(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id", values.free_bytes(F.col("max_bytes"), F.col("used_bytes"), F.col("assigned_bytes")).alias("free"))


@query(f"WITH {SITES_SQL}, {REQUESTS_SQL} SELECT request_id, site_id FROM requests WHERE site_id IN (SELECT site_id FROM sites WHERE status = 'active')")
def cascade_delete(spark, sf_dir):
    alive = sites(spark, sf_dir).filter("status = 'active'")
    return catalog.with_parents(requests(spark, sf_dir).select("request_id", "site_id"), alive, "site_id", "cascade")


@query(f"WITH {SITES_SQL}, {REQUESTS_SQL} SELECT request_id, CASE WHEN site_id IN (SELECT site_id FROM sites WHERE status = 'active') THEN site_id ELSE -1 END AS site_id FROM requests")
def set_null_delete(spark, sf_dir):
    alive = sites(spark, sf_dir).filter("status = 'active'")
    return catalog.with_parents(requests(spark, sf_dir).select("request_id", "site_id"), alive, "site_id", "set null").withColumn("site_id", F.coalesce("site_id", F.lit(-1)))


@query("WITH v AS (SELECT p_partkey, p_size, p_size || '.' || (p_partkey % 12) || '.' || (p_partkey % 7) AS version FROM part) SELECT p_partkey, version, row_number() OVER (ORDER BY p_size, p_partkey % 12, p_partkey % 7, p_partkey) AS position FROM v WHERE (p_size, p_partkey % 12, p_partkey % 7) > (25, 3, 0)")
def version_sort(spark, sf_dir):
    patches = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", "p_size", F.col("p_partkey") % 12, F.col("p_partkey") % 7).alias("version"))
    return catalog.newer_versions(patches, "25.3.0", tie="p_partkey")


@query("SELECT o_custkey AS site_id, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_row(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site_id")).agg(F.max("o_orderdate").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(f"WITH {NODES_SQL} SELECT node_id, round(greatest(used_bytes, assigned_bytes) / max_bytes::DOUBLE, 6) AS share FROM nodes")
def node_ratio(spark, sf_dir):
    return catalog.node_ratio(nodes(spark, sf_dir)).withColumn("share", F.round("share", 6))
