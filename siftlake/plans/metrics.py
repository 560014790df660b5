"""Counters, histograms, gauges, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.operators import metrics
from siftlake.plans.inputs import table
from siftlake.plans.registry import query
from siftlake.sources import exposition as scraped
from siftlake.sources import logs


def bounds_sql(buckets) -> str:
    return ", ".join(f"({b}::DOUBLE)" for b in buckets) + ", ('Infinity'::DOUBLE)"


@query("SELECT event_type, user_id % 10 AS endpoint, count(*) AS total FROM events GROUP BY 1, 2")
def request_counters(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events").withColumn("endpoint", F.col("user_id") % 10), ["event_type", "endpoint"])


@query(f"WITH b(le) AS (VALUES {bounds_sql(metrics.MODEL_BUCKETS)}) SELECT event_type, CASE WHEN isinf(le) THEN 1e9 ELSE le END AS le, count(*) FILTER (value <= le) AS n FROM events, b GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    rows = metrics.histogram(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rows.withColumn("le", F.when(F.col("le") == float("inf"), 1e9).otherwise(F.col("le")))


@query(f"WITH b(le) AS (VALUES {bounds_sql(metrics.REQUEST_BUCKETS)}) SELECT user_id, CASE WHEN isinf(le) THEN 1e9 ELSE le END AS le, count(*) FILTER (value / 100 <= le) AS n FROM events, b GROUP BY 1, 2")
def request_histogram(spark, sf_dir):
    rows = metrics.histogram(table(spark, sf_dir, "events").withColumn("value", F.col("value") / 100), "value", ["user_id"], metrics.REQUEST_BUCKETS)
    return rows.withColumn("le", F.when(F.col("le") == float("inf"), 1e9).otherwise(F.col("le")))


@query("WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM events) SELECT user_id, round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, after) * value), 6) AS ewma FROM e GROUP BY 1")
def latency_ewma(spark, sf_dir):
    rows = metrics.ewma(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"])
    return rows.withColumn("ewma", F.round("ewma", 6))


INCREASES_SQL = "c AS (SELECT user_id, ts, event_id, value, lag(value) OVER w AS before, lag(ts) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, CASE WHEN value >= before THEN value - before ELSE value END AS increase FROM c WHERE before IS NOT NULL)"


@query(f"WITH {INCREASES_SQL} SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS \"begin\", round(sum(increase), 6) AS increase FROM i GROUP BY 1, 2")
def counter_rate(spark, sf_dir):
    rows = metrics.rate(table(spark, sf_dir, "events"), ["user_id"], "value", "ts", "event_id", "6 hours")
    return rows.withColumn("increase", F.round("increase", 6))


@query(f"WITH {INCREASES_SQL} SELECT user_id, round(arg_max(increase / ((epoch_us(ts) - epoch_us(prev_ts)) / 1e6), (ts, event_id)), 6) AS irate FROM i WHERE ts > prev_ts GROUP BY 1")
def counter_irate(spark, sf_dir):
    return metrics.irate(table(spark, sf_dir, "events"), ["user_id"], "value", "ts", "event_id").withColumn("irate", F.round("irate", 6))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def gauge_last(spark, sf_dir):
    return metrics.gauges(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("SELECT event_id, event_type AS metric, CASE WHEN event_type LIKE '%e%' THEN to_json(map {'node': user_id::VARCHAR}) END AS labels FROM events WHERE regexp_matches(event_type, 'click|view')")
def relabelling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric"), F.create_map(F.lit("meta_node"), F.col("user_id").cast("string"), F.lit("tmp"), F.lit("x")).alias("labels"))
    kept = metrics.relabelled(rows, "click|view", "^tmp", ("^meta_", ""))
    return kept.select("event_id", "metric", F.when(F.col("metric").contains("e"), F.to_json("labels").cast("string")).alias("labels"))


@query("SELECT user_id, max(length(props)) AS widest, count(*) AS n FROM events GROUP BY 1")
def widest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.char_length("props")).cast("long").alias("widest"), F.count("*").alias("n"))


@query("SELECT label, max(len(embedding)) AS dimension FROM embeddings GROUP BY 1")
def vector_dimension(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).cast("long").alias("dimension"))


LIMIT = 20_000


@query(f"""WITH lines AS (SELECT event_id, ts, (user_id % 4)::VARCHAR AS pod, strftime(ts, '%Y-%m-%d') AS date, strlen(event_type || ' ' || props) + 1 AS size FROM events),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY pod, date ORDER BY ts, event_id) - size) // ({LIMIT} - (SELECT max(size) FROM lines) + 1) AS file FROM lines)
SELECT pod, date, file::BIGINT AS file, count(*) AS lines, sum(size)::BIGINT AS bytes FROM placed GROUP BY ALL""")
def log_rotation(spark, sf_dir):
    """Events as log lines of four pods, a day's lines in files of at most LIMIT bytes."""
    lines = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 4).cast("string").alias("pod"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat_ws(" ", "event_type", F.coalesce("props", F.lit(""))).alias("line"))
    placed = logs.rotated(lines, ["pod", "date"], ["ts", "event_id"], LIMIT)
    return placed.groupBy("pod", "date", "file").agg(F.count("*").alias("lines"), F.sum("size").alias("bytes"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2)
SELECT user_id, 'events_' || event_type AS metric, CASE WHEN event_type LIKE '%e%' THEN 'counter' ELSE 'untyped' END AS type, 'a"b' || chr(92) || event_type AS path, n::DOUBLE AS value, last AS at_ms FROM n WHERE event_type <> 'click'""")
def exposition(spark, sf_dir):
    """Each user's counts as a service exposes them, read back and relabelled."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    head = F.when(F.col("event_type").contains("e"), F.concat(F.lit("# TYPE events_"), "event_type", F.lit(" counter\n"))).otherwise(F.lit("# HELP x nothing\n\n"))
    line = F.concat(head, F.lit("events_"), "event_type", F.lit('{meta_path="a\\"b\\\\'), "event_type", F.lit('",tmp="}"} '), "n", F.lit(" "), "last", F.lit("\nnot a sample{\n"))
    scrapes = counts.withColumn("line", line).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("text"))
    found = metrics.relabelled(scraped.samples(scrapes, ["user_id"]), "^events_(?!click)", "^tmp", ("^meta_", ""))
    return found.select("user_id", "metric", "type", F.col("labels")["path"].alias("path"), "value", "at_ms")


STEP, SPAN = 21_600, 86_400
RATES_SQL = f"""s AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, value::DECIMAL(18, 6) AS v, lag(epoch_us(ts)) OVER w AS b, lag(value::DECIMAL(18, 6)) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
u AS (SELECT *, CASE WHEN v >= was THEN v - was ELSE v END AS up FROM s),
e AS (SELECT *, unnest(range(((t + {STEP}000000 - 1) // {STEP}000000 * {STEP}000000)::BIGINT, (t + {SPAN}000000)::BIGINT, {STEP}000000)) AS moment FROM u),
g AS (SELECT user_id, event_type, moment, count(*) AS n, min(t) AS a, max(t) AS z, arg_min(v, (t, event_id))::DOUBLE AS v0, coalesce(sum(CASE WHEN b > moment - {SPAN}000000 THEN up END), 0)::DOUBLE AS up,
  arg_max(CASE WHEN b > moment - {SPAN}000000 AND t > b THEN up::DOUBLE * 1000000 / (t - b) END, (t, event_id)) AS irate FROM e GROUP BY ALL HAVING n > 1 AND z > a),
x AS (SELECT *, (z - a)::DOUBLE AS l, (z - a)::DOUBLE / (n - 1) AS m, (moment - z)::DOUBLE AS tail, least((a - moment + {SPAN}000000)::DOUBLE, CASE WHEN up > 0 THEN (z - a)::DOUBLE * v0 / up ELSE (a - moment + {SPAN}000000)::DOUBLE END) AS head FROM g),
rates AS (SELECT user_id, event_type, moment, n, irate, up * (l + CASE WHEN head < m * 1.1::DOUBLE THEN head ELSE m / 2 END + CASE WHEN tail < m * 1.1::DOUBLE THEN tail ELSE m / 2 END) / l / {SPAN} AS rate FROM x)"""


def event_rates(spark, sf_dir):
    return metrics.rates_at(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts", "event_id", STEP, SPAN)


@query(f"WITH {RATES_SQL} SELECT event_type, moment, round(sum(rate::DECIMAL(28, 9))::DOUBLE, 6) AS rate FROM rates GROUP BY ALL")
def dashboard_rate(spark, sf_dir):
    """sum by (event_type) (rate(value[1d])), every six hours."""
    return metrics.by_label(event_rates(spark, sf_dir), ["event_type"], "rate").withColumn("rate", F.round("rate", 6))


@query(f"WITH {RATES_SQL} SELECT user_id, moment, round(sum(irate::DECIMAL(28, 9))::DOUBLE / count(*), 6) AS irate FROM rates WHERE irate IS NOT NULL GROUP BY ALL")
def dashboard_irate(spark, sf_dir):
    """avg by (user_id) (irate(value[1d])), every six hours."""
    return metrics.by_label(event_rates(spark, sf_dir), ["user_id"], "irate", "avg").withColumn("irate", F.round("irate", 6))
