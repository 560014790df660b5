"""Queue outcomes and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts that a message has by default; seconds without a failure that end a count, and that a tenant's letters are kept;
#: failures that raise an alert.
MAX_RETRIES, QUIET_S, KEPT_S, ALERT = 3, 3600, 24 * 3600, 100


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_defaults(payload: DataFrame, now_ms: Column) -> DataFrame:
    """New messages: language auto, three attempts, pending, this time, no attempts yet."""
    return payload.withColumns({
        "language": F.coalesce(F.nullif("language", F.lit("")), F.lit("auto")),
        "max_retries": F.when(F.coalesce("max_retries", F.lit(0)) <= 0, MAX_RETRIES).otherwise(F.col("max_retries")),
        "status": F.lit("PENDING"),
        "timestamp_millis": F.coalesce("timestamp_millis", now_ms),
        "retry_count": F.coalesce("retry_count", F.lit(0)),
    })


def after_failure(failed: DataFrame, now_ms: Column) -> DataFrame:
    """Failed messages with one attempt more: DEAD_LETTER once they have had max_retries, else FAILED, to be sent again."""
    n = F.col("retry_count") + 1
    return failed.withColumns({"retry_count": n, "status": F.when(n >= F.col("max_retries"), "DEAD_LETTER").otherwise("FAILED"), "last_retry_timestamp": now_ms})


def split_poison(raw: DataFrame, schema, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(messages that can be read, as columns of schema; the others as they came)."""
    read = raw.withColumn("_m", F.from_json(column, f"struct<{schema.simpleString()[7:-1]},_corrupt:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_m").isNull() | F.col("_m._corrupt").isNotNull()
    return read.filter(~bad).select("_m.*").drop("_corrupt"), read.filter(bad).select(column)


def sessions(failures: DataFrame, key: str = "site_id", ts: str = "ts", quiet_s: int = QUIET_S) -> DataFrame:
    """key, begin, last, n: failures with less than quiet_s between neighbours. For streams, add a watermark on ts before."""
    s = F.session_window(F.col(ts), f"{quiet_s} seconds")
    return failures.groupBy(F.col(key), s).agg(F.min(ts).alias("begin"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("session_window")


def alerts(failures: DataFrame, threshold: int = ALERT, **how) -> DataFrame:
    """One row for each session that reaches the threshold."""
    return sessions(failures, **how).filter(F.col("n") >= threshold)


def running_counts(failures: DataFrame, key: str = "site_id", ts: str = "ts", tie: str = "event_id", quiet_s: int = QUIET_S) -> DataFrame:
    """Each failure with the count of its session so far."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    start = F.coalesce((_micros(F.col(ts)) - _micros(F.lag(ts).over(w)) >= quiet_s * 1_000_000).cast("int"), F.lit(1))
    marked = failures.withColumn("_start", start).withColumn("_session", F.sum("_start").over(w))
    return marked.withColumn("n", F.row_number().over(Window.partitionBy(key, "_session").orderBy(ts, tie))).drop("_start", "_session")


def live(letters: DataFrame, now: Column, key: str = "site_id", ts: str = "ts", kept_s: int = KEPT_S) -> DataFrame:
    """Letters still kept at `now`: each new one keeps all of its tenant's for another kept_s, so those of the last session,
    if that is recent enough."""
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    ends = F.coalesce((_micros(F.lag(ts).over(w)) - _micros(F.col(ts)) >= kept_s * 1_000_000).cast("int"), F.when(_micros(now) - _micros(F.col(ts)) >= kept_s * 1_000_000, 1).otherwise(0))
    return letters.withColumn("_gone", F.sum(ends).over(w)).filter("_gone = 0").drop("_gone")


def append(letters: DataFrame, counters: DataFrame, new: DataFrame, now: Column, key: str = "site_id", ts: str = "ts", kept_s: int = KEPT_S, quiet_s: int = QUIET_S) -> tuple[DataFrame, DataFrame]:
    """(letters, counters) after new letters, all later than those before: list, count and ranking from one batch.

    counters: key, n, last, total. n counts a tenant's letters since the last quiet_s without one, total all for the ranking
    (ranked); a tenant's list goes once kept_s have passed without a letter, its counter stays.
    """
    found = sessions(new, key, ts, quiet_s).groupBy(key).agg(F.max_by("n", "begin").alias("_n"), F.max("last").alias("_last"), F.min("begin").alias("_first"), F.count("*").alias("_sessions"), F.sum("n").alias("_all"))
    both = counters.join(found, key, "full")
    goes_on = (F.col("_sessions") == 1) & (_micros(F.col("_first")) - _micros(F.col("last")) < quiet_s * 1_000_000)
    n = F.when(F.col("_n").isNull(), F.col("n")).when(goes_on, F.col("n") + F.col("_n")).otherwise(F.col("_n"))
    after = both.select(key, n.alias("n"), F.coalesce("_last", "last").alias("last"), (F.coalesce("total", F.lit(0)) + F.coalesce("_all", F.lit(0))).alias("total"))
    return live(letters.unionByName(new), now, key, ts, kept_s), after


def ranked(counters: DataFrame, n: int = 10, key: str = "site_id") -> DataFrame:
    """The tenants with the most letters so far."""
    return counters.orderBy(F.desc("total"), key).limit(n)


def status_counts(letters: DataFrame) -> DataFrame:
    """total, pending, reprocessed, discarded; zeros for an empty table."""
    return letters.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "reprocessed", "discarded")])


def top_sites(letters: DataFrame, n: int = 10, key: str = "site_id") -> DataFrame:
    return letters.groupBy(key).agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), key).limit(n)


def tail(letters: DataFrame, n: int = 100, key: str = "site_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last n letters of each tenant, with their position from the oldest of them."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    last = letters.withColumn("_n", back).filter(F.col("_n") <= n).drop("_n")
    return last.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def without_replayed(letters: DataFrame, replayed: DataFrame, by: list[str]) -> DataFrame:
    """Letters that were not replayed; by a message's id, or by tenant and second for the platform's own way."""
    return letters.join(replayed.select(*by).distinct(), by, "left_anti")


def replayable(letters: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Letters that have a payload, oldest first, at most `limit`."""
    ok = letters.filter(F.col("payload").isNotNull() & (F.col("payload") != ""))
    return ok.orderBy(*order).limit(limit) if limit is not None else ok


def as_payload(letters: DataFrame, now_ms: Column) -> DataFrame:
    """Messages to send again: pending, without attempts."""
    return letters.withColumns({"status": F.lit("PENDING"), "retry_count": F.lit(0), "timestamp_millis": now_ms, "error_message": F.lit("")})


def with_status(letters: DataFrame, which: Column, status: str, now: Column) -> DataFrame:
    """Letters after a change of status; reprocessed ones get the time."""
    when = F.when(which & F.lit(status == "reprocessed"), now).otherwise(F.col("reprocessed_at"))
    return letters.withColumns({"status": F.when(which, status).otherwise(F.col("status")), "reprocessed_at": when})


def should_listen(latency_ms: Column, running: Column, draw: Column, target_ms: float = 100.0, p: float = 0.1) -> Column:
    """Whether a consumer takes messages next: always below the latency target; above it a running one goes on with
    chance p, and one that has stopped tries with chance p."""
    return (latency_ms < target_ms) | (draw < p)
