"""Dead letters back to the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.dlq import as_payload, without_replayed
from siftlake.scratch import written
from siftlake.sources.queue import from_bytes, publish


def replay(letters: DataFrame, path: str, limit: int | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages sent, letters that stay) for letters (timestamp, site_id, payload_proto as base64).

    Letters without a readable message stay. The oldest come first, at most `limit`. A dry run sends nothing and keeps
    all. The caller writes what stays where letters are not read from.
    """
    read = letters.withColumn("_m", from_bytes(F.unbase64("payload_proto"))).filter(F.col("payload_proto").isNotNull() & F.col("_m.site_id").isNotNull())
    read = read.orderBy("timestamp", "site_id", "doc_id", "payload_proto")
    chosen = written(read.limit(limit) if limit is not None else read, "replay")  # chosen once: what is sent is what goes
    messages = as_payload(chosen.select("_m.*"), F.unix_millis(F.current_timestamp()))
    if dry_run:
        return messages, letters
    publish(messages, path)
    return messages, without_replayed(letters, chosen, ["site_id", "doc_id", "timestamp"])
