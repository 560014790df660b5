"""The platform's tables, derived from the provided ones. Expressions are the same text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A customer is a tenant; its nation, segment and number stand for what the catalogue would hold.
SITES = {
    "site_id": "cast(c_custkey as bigint)",
    "domain": "concat('site', cast(c_custkey as varchar(20)), '.example.com')",
    "path": "'/'",
    "status": "case c_mktsegment when 'BUILDING' then 'suspended' when 'FURNITURE' then 'revoked' else 'active' end",
    "validation_status": "case c_nationkey % 3 when 0 then 'pending' when 1 then 'verified' else 'failed' end",
    "validation_token": "concat('tok', cast(c_custkey as varchar(20)))",
    "expires_day": "case when c_custkey % 7 = 0 then null else cast(c_custkey % 1000 as bigint) end",
    "estimated_pages": "cast(c_custkey % 200 as bigint)",
    "average_page_size": "cast(500 + (c_custkey * 37) % 4000 as bigint)",
    "st_dev_page_size": "cast((c_custkey * 13) % 1500 as bigint)",
    "node_type": "case when c_nationkey % 2 = 0 then 'redis' else 'qdrant' end",
}
#: A supplier is an index node.
NODES = {
    "node_id": "cast(s_suppkey as bigint)",
    "node_type": "case when s_nationkey % 2 = 0 then 'redis' else 'qdrant' end",
    "status": "case when s_suppkey % 9 = 0 then 'inactive' else 'active' end",
    "max_bytes": "cast(1000000 + (s_suppkey * 7919) % 9000000 as bigint)",
    "used_bytes": "cast((s_suppkey * 104729) % 900000 as bigint)",
    "assigned_bytes": "cast((s_suppkey * 15485863) % 1200000 as bigint)",
}
#: An order asks for index space.
REQUESTS = {
    "request_id": "cast(o_orderkey as bigint)",
    "site_id": "cast(o_custkey as bigint)",
    "node_type": "case when o_orderkey % 2 = 0 then 'redis' else 'qdrant' end",
    "bytes": "cast(floor(o_totalprice * 15) as bigint)",
}
#: An error event is a dead letter of its user.
LETTERS = {
    "event_id": "event_id",
    "site_id": "user_id",
    "ts": "ts",
    "status": "case event_id % 3 when 0 then 'pending' when 1 then 'reprocessed' else 'discarded' end",
    "retry_count": "cast(event_id % 4 as int)",
    "payload": "case when event_id % 5 = 0 then null else props end",
}


def derived(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str], where: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = rows.filter(where) if where else rows
    return rows.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def cte(name: str, table: str, columns: dict[str, str], where: str | None = None) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}{f' WHERE {where}' if where else ''})"


def sites(spark, sf_dir):
    return derived(spark, sf_dir, "customer", SITES)


def nodes(spark, sf_dir):
    return derived(spark, sf_dir, "supplier", NODES)


def requests(spark, sf_dir):
    return derived(spark, sf_dir, "orders", REQUESTS)


def letters(spark, sf_dir):
    return derived(spark, sf_dir, "events", LETTERS, "event_type = 'error'")


SITES_SQL = cte("sites", "customer", SITES)
NODES_SQL = cte("nodes", "supplier", NODES)
REQUESTS_SQL = cte("requests", "orders", REQUESTS)
LETTERS_SQL = cte("letters", "events", LETTERS, "event_type = 'error'")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows
