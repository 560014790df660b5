"""Tenants and index nodes: keys, registration, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlake.functions.values import free_bytes
from siftlake.operators.lists import positioned

#: What an index may take, in bytes.
LEAST_BYTES, MOST_BYTES = 1, 1_000_000_000
#: Steps of size, a sixteenth of a power of two each, up to 64 bits.
STEPS = 1024


def valid_key(now: Column) -> Column:
    """Active and not expired; no expiry means never."""
    return (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def with_site(requests: DataFrame, sites: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """Requests with the site that their key is for; keys that are unknown or not valid have none."""
    known = sites.filter(valid_key(now)).select(F.col("api_key"), "site_id")
    return requests.withColumn("api_key", F.sha2(F.col(key), 256)).join(known, "api_key", "left")


def register(sites: DataFrame, requests: DataFrame) -> DataFrame:
    """Sites after registrations (domain, path, token, expires): a known site gets the new token and is pending, all else of
    it stays; an unknown one is added as pending and suspended."""
    both = sites.alias("s").join(requests.alias("r"), ["domain", "path"], "full")
    hit = F.col("token").isNotNull()
    new = F.col("s.status").isNull()
    return both.select(
        "domain",
        "path",
        F.when(new, "suspended").otherwise(F.col("s.status")).alias("status"),
        F.when(hit, "pending").otherwise(F.col("s.validation_status")).alias("validation_status"),
        F.when(hit, F.col("r.token")).otherwise(F.col("s.validation_token")).alias("validation_token"),
        F.when(hit, "http").otherwise(F.col("s.validation_method")).alias("validation_method"),
        F.coalesce("s.estimated_pages", "r.estimated_pages").alias("estimated_pages"),
    )


def transition(sites: DataFrame, event: Column, token: Column, now: Column) -> DataFrame:
    """Sites after an event each (verify, fail, reset, activate or null): validation_status, status, expires_at, and changed.

    verify and fail need the site's token and a pending or failed site; reset a failed one; activate a verified one.
    """
    state = F.col("validation_status")
    own = (token == F.col("validation_token")) & state.isin("pending", "failed")
    ok = F.coalesce(F.when(event.isin("verify", "fail"), own).when(event == "reset", state == "failed").when(event == "activate", state == "verified"), F.lit(False))
    after = F.when(ok & (event == "verify"), "verified").when(ok & (event == "fail"), "failed").when(ok & (event == "reset"), "pending").otherwise(state)
    on = ok & (event == "activate")
    return sites.withColumns({"validation_status": after, "status": F.when(on, "active").otherwise(F.col("status")), "expires_at": F.when(on, now + F.expr("interval 720 hours")).otherwise(F.col("expires_at")), "changed": ok})


def validation_outcome(attempts: DataFrame, key: list[str], most: int) -> DataFrame:
    """key and outcome: verified once an attempt succeeds, failed after `most` failures, else pending."""
    found = attempts.groupBy(*key).agg(F.max("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failures"))
    return found.select(*key, F.when(F.col("ok"), "verified").when(F.col("failures") >= most, "failed").otherwise("pending").alias("outcome"))


def best_fit(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each request (request_id, node_type, bytes) by itself: the active node of its type with the least free space that
    suffices, the smaller id of equal ones; none if there is no such node or the size is out of range.

    An as-of join without pairs: sizes and free spaces of a type fall into steps of a sixteenth of a power of two. Within
    a step the node comes by a window over the different sizes; where the step has none left, it is the smallest of the
    steps above, a table of at most STEPS rows a type.
    """
    step = lambda c: F.least(F.floor(F.log2(c.cast("double") + 1) * 16), F.lit(STEPS - 1)).cast("int")
    free = free_bytes(F.col("max_bytes"), F.col("used_bytes"), F.col("assigned_bytes"))
    open_ = nodes.filter("status = 'active'").select("node_type", free.alias("_v"), "node_id").filter("_v >= 0")
    open_ = open_.groupBy("node_type", "_v").agg(F.min("node_id").alias("node_id")).withColumn("_step", step(F.col("_v")))
    asked = requests.filter(F.col("bytes").between(LEAST_BYTES, MOST_BYTES)).select("node_type", F.col("bytes").alias("_v")).distinct().withColumn("_step", step(F.col("_v")))
    both = open_.select("node_type", "_step", "_v", "node_id", F.lit(0).alias("_asks")).unionByName(asked.select("node_type", "_step", "_v", F.lit(None).cast("long").alias("node_id"), F.lit(1).alias("_asks")))
    near = F.last("node_id", ignorenulls=True).over(Window.partitionBy("node_type", "_step").orderBy(F.desc("_v"), "_asks"))
    found = both.withColumn("_near", near).filter("_asks = 1").select("node_type", "_step", "_v", "_near")
    steps = open_.groupBy("node_type", "_step").agg(F.min(F.struct("_v", "node_id")).alias("_m"))
    every = asked.select("node_type", "_step").distinct().join(steps, ["node_type", "_step"], "left")
    every = every.unionByName(steps.join(every, ["node_type", "_step"], "left_anti"))
    higher = F.min("_m").over(Window.partitionBy("node_type").orderBy("_step").rowsBetween(1, Window.unboundedFollowing))
    above = every.select("node_type", "_step", higher["node_id"].alias("_above"))
    chosen = found.join(above, ["node_type", "_step"], "left").select("node_type", F.col("_v").alias("bytes"), F.coalesce("_near", "_above").alias("node_id"))
    out = requests.join(chosen, ["node_type", "bytes"], "left").select("request_id", "node_type", "bytes", "node_id")
    return out.withColumn("status", F.when(F.col("node_id").isNull(), "rejected").otherwise("assigned"))


def with_parents(rows: DataFrame, parents: DataFrame, key: str, on_delete: str) -> DataFrame:
    """Rows after parents went: `cascade` drops those without a parent, `set null` empties their key."""
    if on_delete == "cascade":
        return rows.join(parents.select(key).distinct(), key, "left_semi")
    return rows.join(parents.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").withColumn(key, F.when(F.col("_k").isNotNull(), F.col(key))).drop("_k")


def newer_versions(patches: DataFrame, current: str, tie: str = "version") -> DataFrame:
    """Patches above the current version, in version order, equal ones by `tie`."""
    numbers = lambda version: F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    newer = patches.withColumn("_v", numbers("version")).filter(F.col("_v") > numbers(F.lit(current)))
    return positioned(newer, F.col("_v").asc(), F.asc(tie)).drop("_v")


def schema_changes(have: list[str], want: list[str]) -> tuple[list[str], list[str]]:
    """(columns to add, columns to drop)."""
    return [c for c in want if c not in have], [c for c in have if c not in want]


def altered(rows: DataFrame, schema: StructType) -> DataFrame:
    """rows with the columns of a schema: missing ones are added as nulls, others dropped, types changed."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*[(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def rotated(sites: DataFrame, keys: DataFrame) -> DataFrame:
    """Sites with the new keys' hashes, for keys (site_id, key)."""
    return sites.join(keys, "site_id", "left").withColumn("api_key", F.coalesce(F.sha2(F.col("key"), 256), F.col("api_key"))).drop("key")


def node_ratio(nodes: DataFrame) -> DataFrame:
    """node_id and the share of its space that is taken."""
    return nodes.select("node_id", (F.greatest("used_bytes", "assigned_bytes") / F.col("max_bytes")).alias("share"))


def create_tables(spark, schemas: dict, database: str | None = None) -> None:
    """Empty Parquet tables where there are none yet; columns that a table lacks are added, with nulls in its rows."""
    for name, schema in schemas.items():
        full = f"{database}.{name}" if database else name
        if not spark.catalog.tableExists(full):
            spark.createDataFrame([], schema).write.saveAsTable(full, format="parquet")
            continue
        add, _ = schema_changes(spark.table(full).columns, schema.names)
        if add:
            kinds = {f.name: f.dataType.simpleString() for f in schema}
            spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({', '.join(f'`{c}` {kinds[c]}' for c in add)})")
