"""Queue outcomes and dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.operators import dlq, fusion
from siftlake.plans.inputs import LETTERS_SQL, letters, table
from siftlake.plans.registry import query

#: Windows that suit the events' density: about twelve a tenant in 30 days.
QUIET = 6 * 3600
SESSIONS_SQL = f"""{LETTERS_SQL},
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NOT NULL AND epoch_us(ts) - epoch_us(lag(ts) OVER w) < {QUIET}::BIGINT * 1000000 THEN 0 ELSE 1 END AS fresh FROM letters WINDOW w AS (PARTITION BY site_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY ts, event_id) AS session FROM g)"""


@query("SELECT event_id, 'auto' AS language, CASE WHEN event_id % 4 = 0 THEN 3 ELSE (event_id % 4)::INT END AS max_retries, 'PENDING' AS status, 0 AS retry_count FROM events")
def payload_defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("").alias("language"), (F.col("event_id") % 4).cast("int").alias("max_retries"), F.lit(None).cast("long").alias("timestamp_millis"), F.lit(None).cast("int").alias("retry_count"))
    return dlq.with_defaults(rows, F.lit(0).cast("long")).select("event_id", "language", "max_retries", "status", "retry_count")


@query(f"WITH {LETTERS_SQL} SELECT event_id, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 >= 3 THEN 'DEAD_LETTER' ELSE 'FAILED' END AS status FROM letters")
def retry_split(spark, sf_dir):
    rows = letters(spark, sf_dir).select("event_id", "retry_count", F.lit(3).alias("max_retries"))
    return dlq.after_failure(rows, F.lit(0).cast("long")).select("event_id", "retry_count", "status")


@query("SELECT event_id, event_id % 3 > 0 AS readable, CASE WHEN event_id % 3 > 0 THEN event_id ELSE -1 END AS id FROM events")
def poison_routing(spark, sf_dir):
    from siftlake.schemas import PAYLOAD

    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.to_json(F.struct(F.col("event_id").cast("int").alias("id"), F.lit("x").alias("text")))).otherwise(F.concat(F.lit("{broken "), "event_id")).alias("value"))
    good, bad = dlq.split_poison(raw, PAYLOAD)
    read = good.select(F.col("id").cast("long").alias("event_id"), F.lit(True).alias("readable"), F.col("id").cast("long").alias("id"))
    return read.unionByName(bad.select(F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("event_id"), F.lit(False).alias("readable"), F.lit(-1).cast("long").alias("id")))


@query(f"WITH {LETTERS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'reprocessed') AS reprocessed, count(*) FILTER (status = 'discarded') AS discarded FROM letters")
def dlq_status_counts(spark, sf_dir):
    return dlq.status_counts(letters(spark, sf_dir))


@query(f"WITH {LETTERS_SQL} SELECT site_id, count(*) AS failures FROM letters GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def dlq_top_sites(spark, sf_dir):
    return dlq.top_sites(letters(spark, sf_dir))


@query(f"WITH {LETTERS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC, event_id DESC) AS n FROM letters QUALIFY n <= 5) SELECT site_id, event_id, row_number() OVER (PARTITION BY site_id ORDER BY ts, event_id) AS position FROM t")
def dlq_tail_n(spark, sf_dir):
    return dlq.tail(letters(spark, sf_dir), 5).select("site_id", "event_id", "position")


@query(f"WITH {SESSIONS_SQL} SELECT site_id, min(ts) AS \"begin\", max(ts) AS last, count(*) AS n FROM h GROUP BY site_id, session")
def dlq_session_counts(spark, sf_dir):
    return dlq.sessions(letters(spark, sf_dir), quiet_s=QUIET)


@query(f"WITH {SESSIONS_SQL} SELECT site_id, min(ts) AS \"begin\", max(ts) AS last, count(*) AS n FROM h GROUP BY site_id, session HAVING count(*) >= 2")
def dlq_threshold_alerts(spark, sf_dir):
    return dlq.alerts(letters(spark, sf_dir), 2, quiet_s=QUIET)


@query(f"WITH {SESSIONS_SQL} SELECT event_id, row_number() OVER (PARTITION BY site_id, session ORDER BY ts, event_id) AS n FROM h")
def dlq_running_counts(spark, sf_dir):
    return dlq.running_counts(letters(spark, sf_dir), quiet_s=QUIET).select("event_id", "n")


@query(f"""WITH {LETTERS_SQL}, m AS (SELECT max(ts) AS now FROM events),
g AS (SELECT letters.*, now, coalesce(lead(ts) OVER (PARTITION BY site_id ORDER BY ts), now) AS next FROM letters, m),
x AS (SELECT *, max(CASE WHEN epoch_us(next) - epoch_us(ts) >= 259200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY ts DESC) AS gone FROM g)
SELECT site_id, event_id FROM x WHERE gone = 0""")
def dlq_ttl_live(spark, sf_dir):
    """Kept for three days after a tenant's last letter, as of the last event."""
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return dlq.live(letters(spark, sf_dir), F.lit(now).cast("timestamp_ntz"), kept_s=3 * 24 * 3600).select("site_id", "event_id")


@query(f"""WITH {SESSIONS_SQL}, e AS (SELECT site_id, session, count(*) AS n, max(ts) AS last FROM h GROUP BY 1, 2)
SELECT site_id, max_by(n, session) AS n, max(last) AS last, sum(n)::BIGINT AS total FROM e GROUP BY 1""")
def dlq_append(spark, sf_dir):
    """Counters of two batches one after the other."""
    rows = letters(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    none = rows.filter("false").select("site_id", F.lit(0).cast("long").alias("n"), F.col("ts").alias("last"), F.lit(0).cast("long").alias("total"))
    now, cut = F.lit("2024-03-01").cast("timestamp"), "timestamp'2024-01-16'"
    _, first = dlq.append(rows.filter("false"), none, rows.filter(f"ts < {cut}"), now, quiet_s=QUIET)
    _, both = dlq.append(rows.filter(f"ts < {cut}"), first, rows.filter(f"ts >= {cut}"), now, quiet_s=QUIET)
    return both.withColumn("last", F.col("last").cast("timestamp_ntz"))


@query(f"WITH {LETTERS_SQL} SELECT event_id, site_id FROM letters WHERE NOT (payload IS NOT NULL AND payload <> '' AND status = 'pending')")
def dlq_replay_antijoin(spark, sf_dir):
    rows = letters(spark, sf_dir)
    replayed = dlq.replayable(rows.filter("status = 'pending'"))
    return dlq.without_replayed(rows, replayed, ["event_id"]).select("event_id", "site_id")


@query(f"WITH {LETTERS_SQL}, s AS (SELECT *, epoch(ts)::BIGINT AS second FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM letters)) SELECT event_id, site_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.site_id = a.site_id AND b.second = a.second AND b.event_id % 2 = 0)")
def dlq_replay_by_second(spark, sf_dir):
    """The platform's own way: letters of the tenant and second of a replayed one go with it."""
    rows = letters(spark, sf_dir).withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    return dlq.without_replayed(rows, rows.filter("event_id % 2 = 0"), ["site_id", "second"]).select("event_id", "site_id")


@query(f"WITH {LETTERS_SQL} SELECT event_id FROM letters WHERE payload IS NOT NULL ORDER BY ts, event_id LIMIT 25")
def dlq_replay_limit(spark, sf_dir):
    return dlq.replayable(letters(spark, sf_dir), 25).select("event_id")


@query(f"WITH {LETTERS_SQL} SELECT event_id, CASE WHEN retry_count = 3 THEN 'reprocessed' ELSE status END AS status, CASE WHEN retry_count = 3 THEN ts END AS reprocessed_at FROM letters")
def dlq_status_update(spark, sf_dir):
    rows = letters(spark, sf_dir).withColumn("reprocessed_at", F.lit(None).cast("timestamp_ntz"))
    return dlq.with_status(rows, F.col("retry_count") == 3, "reprocessed", F.col("ts")).select("event_id", "status", "reprocessed_at")


@query(f"WITH {LETTERS_SQL} SELECT event_id, ts FROM letters WHERE status = 'pending' ORDER BY ts, event_id LIMIT 20")
def dlq_oldest_pending(spark, sf_dir):
    return letters(spark, sf_dir).filter("status = 'pending'").orderBy("ts", "event_id").select("event_id", "ts").limit(20)


@query("SELECT user_id AS site_id, count(*) AS received, count(*) FILTER (event_type <> 'error') AS pending, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 202 ELSE 500 END AS code FROM events GROUP BY 1")
def store_tallies(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("site_id")).agg(F.count("*").alias("received"), F.count_if(~bad).alias("pending"), F.count_if(bad).alias("failed")).withColumn("code", F.when(F.col("pending") > 0, 202).otherwise(500))


@query("SELECT event_id, value::DOUBLE AS score FROM events WHERE event_id % 3 > 0")
def scored_only(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("id"), F.col("value").cast("string").alias("score"))
    return fusion.scored_only(rows).select(F.col("id").alias("event_id"), "score")


@query("SELECT event_id, value < 100 OR (event_id % 100) / 100.0 < 0.1 AS listens FROM events")
def load_shedding(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", dlq.should_listen(F.col("value"), F.lit(True), F.col("event_id") % 100 / 100.0).alias("listens"))
