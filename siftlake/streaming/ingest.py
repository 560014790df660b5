"""The ingest stream: queue messages to chunks, failures to another attempt or to the dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import detected, language_rule
from siftlake.operators.chunking import chunk_documents
from siftlake.operators.dlq import after_failure, split_poison, with_defaults
from siftlake.operators.search import with_vectors
from siftlake.operators.store import with_point_ids
from siftlake.schemas import PAYLOAD
from siftlake.scratch import Scratch

#: Languages that texts may have; others are unknown.
ALLOWED = ["en", "fr", "de", "es", "it", "ro"]


def enrich(messages: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages of active tenants with their chunk limits, the others with an error)."""
    known = sites.filter("status = 'active'").select("site_id", "chunk_size", "chunk_overlap", F.lit(True).alias("_known"))
    joined = messages.join(known, "site_id", "left")
    good = joined.filter("_known").drop("_known")
    return good, joined.filter("_known is null").drop("_known", "chunk_size", "chunk_overlap").withColumn("error_message", F.lit("unknown or inactive site"))


def step(raw: DataFrame, sites: DataFrame, now_ms, model: str = "arctic", allowed: list[str] = ALLOWED, made: list[Scratch] | None = None) -> dict[str, DataFrame]:
    """One batch of raw messages (value): chunks to store, with language and vectors, messages to send again, dead letters,
    and what can't be read.

    A message fails whose tenant is unknown, or on any of whose chunks the model fails; none of its chunks are stored. The
    chunks are written once, so that the model is called once for each; their table is added to `made`, for the caller to
    drop when the results are stored.
    """
    messages, poison = split_poison(raw, PAYLOAD)
    good, bad = enrich(with_defaults(messages, now_ms), sites)
    found = detected(F.col("text"))
    good = good.withColumn("language", language_rule(F.col("language"), found["language"], found["score"], allowed))
    cut = chunk_documents(good.select("site_id", F.col("id").alias("post_id"), "language", "text", "chunk_size", "chunk_overlap"), "chunk_size", "chunk_overlap")
    chunks = Scratch(with_vectors(cut, model, "store", F.col("language")).select("site_id", "post_id", "offset", "text", "language", "dense", "sparse", "error"), "ingest")
    if made is not None:
        made.append(chunks)
    errors = chunks.df.filter("error is not null").groupBy("site_id", "post_id").agg(F.min("error").alias("error_message"))
    lost = good.drop("chunk_size", "chunk_overlap", "error_message").join(errors.withColumnRenamed("post_id", "id"), ["site_id", "id"])
    failed = after_failure(bad.unionByName(lost), now_ms)
    return {
        "chunks": with_point_ids(chunks.df.drop("error").join(errors.select("site_id", "post_id"), ["site_id", "post_id"], "left_anti")),
        "retry": failed.filter("status = 'FAILED'"),
        "dead": failed.filter("status = 'DEAD_LETTER'"),
        "poison": poison,
    }


def start(raw: DataFrame, read_sites: Callable[[], DataFrame], sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None, model: str = "arctic"):
    """A stream of raw messages into sinks by name; tenants are read again for each batch. every: seconds between batches,
    else all there is now."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        made: list[Scratch] = []
        try:
            for name, part in step(rows, read_sites(), F.unix_millis(F.current_timestamp()), model, made=made).items():
                if name in sinks:
                    sinks[name](part, number)
        finally:
            rows.unpersist()
            for table in made:
                table.drop()

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
